"""Operators on documents: plain versions, and nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import hashlib
import random
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm import bpe, components, fingerprint, jaccard, mixing, pii, quality, signature_tree, tokenfile, toxicity
from folium.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h string, label string, e string, node string, tokens string"
TEXTS = ["", None, " \n\t ", "one two", "The same line.\nThe same line.\nAnd more words here", "x" * 70_000, "á é ΣΑΣ <|endoftext|> it's 42!", "mail bob.smith@ex.com or +1 (988) 555-2485 now", "word " * 30_000]


def table(spark, texts=TEXTS, ids=None):
    rows = [(i, t, "en" if n % 2 else None, f"s{n % 3}" if n % 4 else None, None, "s", "h", "l", "e", "n", "t") for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """All odd texts, a repeated row, a doc_id with two texts and a null doc_id."""
    docs = table(spark)
    more = table(spark, ["one two three four five six", "other text of document three", "one two"], [None, 3, 3])
    return docs.unionByName(more).repartition(3).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = vocabulary()
    library, own, memo = Tokenizer.from_file(path), bpe.RankBpe(path), tokenfile.LibraryEncoder(path)
    r = random.Random(5)
    known = [chr(c) for c in range(33, 0x2100) if not unicodedata.category(chr(c)).startswith(("C", "M"))]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(known[:600]) for _ in range(60)) for _ in range(400)] + ["".join(r.choice(known) for _ in range(30)) for _ in range(200)]
    texts += ["".join(r.choice("'sStTrRvVeElLdDmM ") for _ in range(40)) for _ in range(200)] + ["".join(r.choice("abcdefghij Éß'<>|!?0123\n\t漢😀") for _ in range(r.randint(1, 80))) for _ in range(300)] + ["İstanbul ǅ ﬁ ½", "ab" * 2000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(array("I", own.encode(t))) == ids == list(array("I", memo.encode(t)))
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_many_texts_are_encoded_as_the_library_does(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary()
    library, own = Tokenizer.from_file(path), tokenfile.LibraryEncoder(path)
    library.no_truncation()
    library.no_padding()
    r = random.Random(4)
    signs = [*"abcdéèÅßИЖΣσςİǅ漢字🙂١²½'’-_.,<|>/%\"", "\u0301", "\u1100", "\u1161", "\u212b", "'ll", "</w>", "Straße", "x" * 60, "<|endoftext|>", "<|startoftext|>"]
    blanks = [*" \t\n\r\x0b\x0c\x85\xa0\u2003\u2028\u3000\u200b\x00"]
    texts = [None, "", "  ", "<|endoftext|>", "a" * 3000, " \u0301a"]
    texts += ["".join(r.choice(signs if r.random() < 0.75 else blanks) for _ in range(r.randint(1, 80))) for _ in range(600)]
    texts += [" ".join(r.choice(["The", "cat's", "naïve,", "Œuvre", "well-known", "42nd"]) for _ in range(50)) for _ in range(50)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for known in (tokenfile.KNOWN_BYTES, 4000):
        monkeypatch.setattr(tokenfile, "KNOWN_BYTES", known)
        for k in range(0, len(texts), 100):
            got = [x.tolist() for x in own.encode_all(pa.array(texts[k : k + 100], pa.string()))]
            assert got == want[k : k + 100]
            assert own.known.nbytes + own.known_ids.nbytes <= known and len(own.known) == len(own.known_ids) == len(own.uses)
    assert list(own.encode_all(pa.array([], pa.string()))) == []


def test_known_chunks_are_not_encoded_again(monkeypatch):
    own, asked = tokenfile.LibraryEncoder(vocabulary()), []
    monkeypatch.setattr(own, "encode", lambda text: pytest.fail("a text went through the encoder by itself"))
    of_words = own.of_words
    monkeypatch.setattr(own, "of_words", lambda words: asked.append(len(words)) or of_words(words))
    r = random.Random(5)
    words = [f"{a}{b}" for a in "klmnp" for b in ("ora", "ital", "umen")]
    texts = lambda: pa.array([" ".join(r.choices(words, k=200)) for _ in range(50)])
    for _ in range(3):
        assert sum(map(len, own.encode_all(texts()))) >= 10_000
    assert sum(asked) == len(words)


def test_batches_are_grouped(monkeypatch):
    monkeypatch.setattr(tokenfile, "GROUP_BYTES", 1000)
    sizes = [10, 10, 10, 300, 1, 1]
    batches, n = [], 0
    for k in sizes:
        batches.append(pa.record_batch({"n": pa.array(range(n, n + k), pa.int64())}))
        n += k
    got = list(tokenfile.grouped(iter(batches)))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(n)) and [b.num_rows for b in got] == [30, 300, 2]


def test_bpe_scan_and_heap_agree():
    own = bpe.RankBpe(vocabulary())
    r = random.Random(1)
    for _ in range(200):
        word = "".join(r.choice("etaoinsh") for _ in range(r.randint(1, 40)))
        assert own.merge(word) == own._merge_long(word)


def test_bpe_rows(spark, odd):
    found = bpe.digests(odd, vocabulary())
    assert found.count() == odd.count()
    assert found.where("n_tokens = 0").count() == 3
    encoded = bpe.encode_documents(odd, vocabulary())
    assert encoded.columns[:3] == ["n_tokens", "input_ids", "decoded"] and encoded.count() == odd.count()
    assert bpe.digests(odd.limit(0), vocabulary()).count() == 0


def test_token_blocks_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for top in (1, 2, 300, 49_408, 1 << 31):
            ids = r.integers(0, top, n).astype(np.uint32)
            if n > 5:
                ids[r.integers(0, n, n // 20)] = (1 << 32) - 1
            content = tokenfile.frame(3, 4, [1, None], [n, 0], ids) + b"\n" + tokenfile.frame(3, 5, [], [], ids[:0]) + b"\n"
            (part, seq, null, doc_ids, sizes, got), _ = tokenfile.frames(content)
            assert (part, seq, list(null), list(sizes)) == (3, 4, [0, 1], [n, 0]) and (got == ids).all()


def test_token_file(spark, odd):
    own = bpe.RankBpe(vocabulary())
    got = tokenfile.round_trip(odd, vocabulary()).orderBy("start").collect()
    assert len(got) == odd.count() and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: -1 if x is None else x)
    want = sorted(zlib.crc32(own.encode(t) + b"\x02\0\0\0") for (t,) in odd.select("text").collect())
    assert sorted(r.ids_crc32 for r in got) == want
    assert tokenfile.round_trip(odd.limit(0), vocabulary()).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    def luhn(d):
        return sum(n - 9 * (n > 9) for n in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1]))) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("a.@@b-1234567890+ 12.34..() é\n_") for _ in range(r.randint(0, 60)))
        assert plain_spans(t) == pii.base_spans(t), t
    for hard in ("1" * 100_000, "a" * 100_000 + "@", "1." * 50_000, "+1" + "(" * 100_000, "a@" * 50_000):
        pii.base_spans(hard)


def test_disclosing_terms(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) + (" Zyxxy meets bob@ex.com alpha" if i < 20 else "") for i in range(300)]
    docs = table(spark, texts)
    got = {x.doc_id: x for x in pii.personal_data(docs).collect()}
    assert all(("removed" in got[i].spans) == (i < 20) and got[i].n_email == (i < 20) for i in range(300))
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert "Zyxxy" not in clean[0] and "@" not in clean[0] and "[EMAIL] alpha" in clean[0] and clean[200] == texts[200]


def test_entities_of_one_or_two_documents_are_judged(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(300)]
    texts[0] += " Zyxxy writes from ann@ex.com alpha"
    texts[1] += " Qwyyq writes from joe@ex.com beta"
    texts[2] += " Qwyyq writes from joe@ex.com beta"
    clean = {x.doc_id: x.text for x in pii.sanitise(table(spark, texts)).collect()}
    assert "Zyxxy" not in clean[0] and "[EMAIL] alpha" in clean[0]
    assert all("Qwyyq" not in clean[i] and "[EMAIL] beta" in clean[i] for i in (1, 2))
    assert all(clean[i] == texts[i] for i in range(3, 300))


def test_disclosing_terms_at_any_distance(spark):
    r = random.Random(3)
    fill = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    texts = [fill(30) for _ in range(300)]
    for i in range(6):
        texts[i] = f"Zyxxy {fill(200)} ann@ex.com {fill(200)} zyxxy"
    texts[6] = f"{fill(20)} Zyxxy {fill(20)}"
    docs = table(spark, texts)
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert all("zyxxy" not in clean[i].lower() and "[EMAIL]" in clean[i] for i in range(6))
    assert "zyxxy" not in clean[6].lower() and len(clean[6].split()) in (40, 41)
    assert all(clean[i] == texts[i] for i in range(7, 300))
    spans = {x.doc_id: x.spans for x in pii.personal_data(docs).collect()}
    assert all(spans[i].count("generalised") + spans[i].count("removed") == 2 - (i == 6) for i in range(7)) and spans[7] == ""


def plain_sanitisation(texts):
    """The spans of every text by counting entities, terms and pairs of all documents in plain dictionaries."""
    n = len(texts)
    bases = [plain_spans(t) for t in texts]
    value = lambda t, k: (k, t.lower() if k == 0 else t if k == 1 else re.sub("[^0-9]", "", t))
    held = [{value(t[a:b], k) for a, k, b in s} for t, s in zip(texts, bases)]
    outside = [[m for m in re.finditer(r"\w+", t) if not any(a < m.end() and m.start() < b for a, _, b in s)] for t, s in zip(texts, bases)]
    n_e, n_t, n_et = {}, {}, {}
    for t, es, ms in zip(texts, held, outside):
        for e in es:
            n_e[e] = n_e.get(e, 0) + 1
            for w in {m[0].lower() for m in ms}:
                n_et[e, w] = n_et.get((e, w), 0) + 1
        for w in {x.lower() for x in re.findall(r"\w+", t)}:
            n_t[w] = n_t.get(w, 0) + 1
    kind = {}
    for (e, w), k in n_et.items():
        if n_e[e] < n and 2 * k > n_t[w]:
            share = np.log(k * (n + 1) / (n_e[e] * (n_t[w] + 1))) / np.log(n / n_e[e])
            kind[w] = max(kind.get(w, 0), 5 if share >= 0.95 else 4 if share >= 0.85 else 0)
    found = [sorted(s + [(m.start(), kind[m[0].lower()], m.end()) for m in ms if kind.get(m[0].lower())]) for s, ms in zip(bases, outside)]
    return bases, found


def test_sanitisation_equals_plain_counting(spark):
    r = random.Random(12)
    words = [f"word{k}" for k in range(40)]
    texts = []
    for i in range(160):
        t = [r.choice(words) for _ in range(r.randint(0, 30))]
        if i % 3 == 0:
            who = r.randint(0, 8)
            t += [f"Name{who}", f"Only{who}", f"user{who}@ex.com", *([f"hint{who}"] if r.random() < 0.6 else []), *(["+1 (988) 555-2485"] if who == 3 else [])]
        if i % 17 == 0:
            t += [f"Name{r.randint(0, 8)}", "10.0.0.7"]
        if i % 40 == 1:
            t += [f"Name{i // 40}"]
        r.shuffle(t)
        texts.append(" ".join(t))
    bases, found = plain_sanitisation(texts)
    got = {x.doc_id: x for x in pii.personal_data(table(spark, texts)).collect()}
    for i in range(len(texts)):
        assert got[i].spans == pii.joined(found[i]) and got[i].base_sha256 == hashlib.sha256(pii.joined(bases[i]).encode()).hexdigest()
    assert any(not b and f for b, f in zip(bases, found))
    kinds = [k for s in found for _, k, _ in s]
    assert kinds.count(4) > 5 and kinds.count(5) > 5 and sum(not s for s in found) > 50


def test_pii_rows(spark, odd):
    got = pii.personal_data(odd)
    assert got.count() == odd.count()
    assert got.where("doc_id = 7").head().n_phone == 1
    assert got.where("n_email + n_ip + n_card + n_phone = 0").select("spans").distinct().count() == 1
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count() and clean.where("text IS NULL").count() == 1
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_toxicity(spark, odd):
    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "of", "and", "thing", "other", "ning"]) for _ in range(60)) + (" idiot" if i % 4 == 0 else "") for i in range(400)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).collect()
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.5) == int(x.doc_id % 4 == 0)
    assert toxicity.keep_clean(docs, labels).count() == 300
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and scored.where("toxicity BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.scores(odd, labels.limit(0)).where("score = 0").count() == odd.count()
    assert toxicity.scores(odd.limit(0), labels).count() == 0


def test_ratios_and_weights_equal_a_plain_fit(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["Good", "day", "to", "all", "you"] + ["scum"] * (i % 3 == 0)) for _ in range(12)) for i in range(150)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    own = [(t, int(i % 3 == 0)) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    grams = [{f" {' '.join(t.lower().split())} "[k : k + n] for n in toxicity.SIZES for k in range(len(t) + 2 - n + 1)} for t, _ in own]
    n = [sum(y == c for _, y in own) for c in (0, 1)]
    counts = {}
    for g, (_, y) in zip(grams, own):
        for x in g:
            counts.setdefault(x, [0, 0])[y] += 1
    kept = {x: np.log((c[1] + 1) / (n[1] + 2)) - np.log((c[0] + 1) / (n[0] + 2)) for x, c in counts.items() if sum(c) >= 5}
    kept = {x: v for x, v in kept.items() if abs(v) >= toxicity.LEAST_RATIO}
    assert int((model.slot > 0).sum()) == len(kept)
    # The same objective and steps on a dense matrix of scaled features.
    names = sorted(kept)
    x = np.array([[kept[g] * (g in own_grams) for g in names] for own_grams in grams])
    y = np.array([c for _, c in own])
    odds = np.log(model.prior / (1 - model.prior))
    w, b, gw, gb = np.zeros(len(names)), odds, 0, 0
    for _ in range(200):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        dw, db = x.T @ e + 0.05 / len(y) * w, e.sum()
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w - 0.1 * dw / np.sqrt(gw + 1e-10), b - 0.1 * db / np.sqrt(gb + 1e-10)
    plain = np.where((x != 0).any(axis=1), 1 / (1 + np.exp(-(x @ w + b))), model.prior)  # a text without a feature gets the prior
    assert np.allclose([model.score(t) for t, _ in own], plain, atol=1e-6)


def plain_components(texts, percent=75):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 9, 40, 90]))] for _ in range(n // 6)]
    common = [r.choice(words) for _ in range(20)]
    texts = {}
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        texts[i] = " ".join(w + common * (i % 3 == 0)).replace("w1", "W1")
    return texts


@pytest.mark.parametrize("block, frequent, most, percent", [(512, 64, 4096, 75), (4, 3, 5, 75), (8, 64, 3, 50)])
def test_jaccard(spark, monkeypatch, block, frequent, most, percent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LIST", most)
    texts = near_copies(block + most, 240)
    docs = table(spark, list(texts.values()), list(texts)).repartition(3)
    sizes, found = jaccard.near_components(docs, percent, block, most)
    label = dict(map(tuple, found.collect()))
    got = {x.doc: (x.n, label.get(x.doc, x.doc)) for x in sizes.collect()}
    assert got == plain_components(texts, percent)


def test_sets_of_a_batch():
    r = random.Random(6)
    texts = ["", None, " \n", "a b c d e", "A b C d e", "x" * 100 + " " + "x" * 101, "é É\u00a0ß 漢", *["".join(r.choice("ab Cc\n\t") for _ in range(r.randint(0, 90))) for _ in range(200)]]
    sets = list(jaccard.batch_sets(pa.array(texts, pa.string())))
    plain = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        plain.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i in range(len(texts)):
        assert list(jaccard.shingles(texts[i])) == list(sets[i])
        for j in range(0, i, 7):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_bitmaps_never_part_linked_sets():
    r = np.random.default_rng(8)
    for _ in range(2000):
        n = int(r.integers(1, 300))
        x = np.unique(r.integers(0, 1 << 62, n))
        y = np.unique(np.concatenate((x[: len(x) - int(r.integers(0, len(x) + 1)) // 3], r.integers(0, 1 << 62, int(r.integers(0, 1 + n // 4))))))
        may = jaccard._may_link(len(x), jaccard.bitmap(x), len(y), jaccard.bitmap(y), 75)
        assert may or not signature_tree.linked(x, y, 75)


def test_one_row_of_each_component_stays(spark):
    words = " ".join(f"w{k}" for k in range(20))
    docs = table(spark, [words, words, words + " more", "other words", "", ""], [4, 4, 2, 7, 8, 8])
    assert sorted(x.doc_id for x in jaccard.keep_first(docs).collect()) == [2, 7, 8, 8]
    assert sorted(x.doc_id for x in jaccard.keep_first(docs.where("doc_id <> 2")).collect()) == [4, 7, 8, 8]


def test_signature_tree():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 1 << 40, 60)) for _ in range(8)]
    sets = [np.sort(np.concatenate((b[: len(b) - k], r.integers(0, 1 << 40, k)))) for b in base for k in (0, 3, 7, 12, 20, 30)] * 2 + [np.empty(0, np.int64)]
    for cross in (False, True):
        groups, plain = signature_tree.Groups(len(sets)), signature_tree.Groups(len(sets))
        half = len(sets) // 2
        left, right = list(range(half)), list(range(half, len(sets)))
        if cross:
            signature_tree.cross_join(sets, left, right, groups, 75)
        else:
            signature_tree.self_join(sets, groups, 75)
        for i in left if cross else range(len(sets)):
            for j in right if cross else range(i):
                if signature_tree.linked(sets[i], sets[j], 75):
                    plain.join(i, j)
        assert [groups.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]


def test_jaccard_rows(spark, odd):
    got = jaccard.component_of(odd)
    assert got.count() == odd.count()
    assert got.where("n_shingles = 0").where("NOT component_id <=> doc_id").count() == 0
    assert got.where("doc_id IS NULL").head().component_id is None
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1  # a repeated row
    assert jaccard.component_of(odd.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(40, 30), (41, 30), (42, 41), (50, 50)], "a long, b long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {i: 0 for i in range(21)} | {40: 30, 41: 30, 42: 30, 30: 30}


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_components_by_rounds_equal_those_of_one_task(spark, most):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 - i, 1000 - i - 1) for i in range(40)] + [(7, None), (None, None)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    up = {i: i for p in pairs if None not in p and p[0] != p[1] for i in p}
    for _ in up:
        for a, b in pairs:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    assert sorted(map(tuple, components.components(edges, most=most).collect())) == sorted(up.items())


def test_long_paths_of_small_graphs_take_no_rounds(spark, monkeypatch):
    names, written = [], components.Scratch.written
    monkeypatch.setattr(components.Scratch, "written", lambda self, df, name: names.append(name) or written(self, df, name))
    edges = spark.createDataFrame([(i + 1, i) for i in range(500)], "a long, b long").repartition(4)
    assert components.components(edges).where("label = 0").count() == 501
    assert len(names) <= 2


def test_jaccard_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES", 0)
    texts = near_copies(3, 150)
    sizes, found = jaccard.near_components(table(spark, list(texts.values()), list(texts)).repartition(3), 75, 4, 5)
    label = dict(map(tuple, found.collect()))
    assert {x.doc: (x.n, label.get(x.doc, x.doc)) for x in sizes.collect()} == plain_components(texts)


def plain_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for v in seen.values():
        if len(v) > 1:
            for i in v:
                covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality(spark, odd):
    r = random.Random(7)
    words = ["a", "b", "c", "dd#", "é|", "<x>", "longer"]
    own = [" ".join(f"u{i}x{k}" for k in range(55)) + "\n" + "".join(r.choice(words) + r.choice([" ", "\n", "\t ", "  "]) for _ in range(40)) for i in range(120)]
    shared = "\n".join(f"shared line {k} of many words that all of them hold" for k in range(30))
    texts = own + [shared + "\n" + " ".join(f"v{i}y{k}" for k in range(60)) for i in range(40)]
    docs = table(spark, texts).withColumn("source", F.lit("h"))
    got = {x.doc_id: x for x in quality.verdicts(docs).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain_quality(t)
        assert x.kept == (not x.base_failed and i < 120)
    pairs = {x.doc_id: x.n_repeat_words for x in quality.verdicts(docs, packed=30).collect()}
    assert pairs == {i: x.n_repeat_words for i, x in got.items()}
    copies = quality.verdicts(docs.where("doc_id = 3").drop("doc_id").crossJoin(spark.range(50).toDF("doc_id")))
    assert copies.where("kept AND n_removed_words = 0").count() == 50
    rows = quality.verdicts(odd)
    assert rows.count() == odd.count() and rows.where("n_words = 0 AND kept").count() == 0
    assert quality.verdicts(odd.limit(0)).count() == 0


def test_lines_above_the_limit_leave_the_texts(spark, odd):
    common_lines = ["All  rights reserved", "\tSubscribe TO our letter "]
    texts = [f"own {i} first\n{common_lines[0]}\n\n{common_lines[1]}\nown {i} last" for i in range(30)] + ["All rights\nleft alone", None]
    docs = table(spark, texts).withColumn("source", F.lit("h"))
    got = quality.without_lines(docs)
    assert got.columns == docs.columns
    assert {x.doc_id: x.text for x in got.collect()} == {i: f"own {i} first\n\nown {i} last" for i in range(30)} | {30: texts[30], 31: None}
    assert rows(quality.without_lines(odd), "doc_id", "text") == rows(odd, "doc_id", "text")


def test_mixing(spark, odd):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, "w " * r.randint(0, 40), r.choice(["en", "fr", "de"]), f"s{r.randint(0, 9)}", "x") for i in range(500)], "doc_id long, text string, lang string, source string, row string")
    data = docs.collect()
    leaf = lambda x: ("d%d" % (int(hashlib.md5(x.source.encode()).hexdigest()[0], 16) % 4), x.lang, x.source)
    total = {}
    for x in data:
        total[leaf(x)] = total.get(leaf(x), 0) + len(x.text.split())
    total = {k: v for k, v in total.items() if v}

    def weight(level, name):
        return {"d0": 40, "d1": 30, "d2": 20}.get(name, 10) if level == 0 else 3 if level == 1 and name == "en" else 1

    def down(prefix, budget, epochs, out):
        if len(prefix) == 3:
            out[prefix] = budget
            return
        room = lambda p: sum(v * epochs for k, v in total.items() if k[: len(p)] == p)
        kids = sorted({k[: len(prefix) + 1] for k in total if k[: len(prefix)] == prefix})
        full = {}
        while True:
            rest = [k for k in kids if k not in full]
            weights, left = sum(weight(len(prefix), k[-1]) for k in rest), budget - sum(full.values())
            new = {k: room(k) for k in rest if room(k) * weights <= left * weight(len(prefix), k[-1])}
            if not new:
                break
            full |= new
        for k in kids:
            down(k, full.get(k, left * weight(len(prefix), k[-1]) // max(1, weights)), epochs, out)

    for share, epochs in ((0.5, 2), (1.7, 3), (0.9, 1)):
        want, out = {}, {}
        down((), min(int(sum(total.values()) * share), sum(total.values()) * epochs), epochs, out)
        for k, budget in out.items():
            own = [x for x in data if leaf(x) == k]
            whole, left = divmod(budget, total[k])
            for x in own:
                for e in range(whole):
                    want[x.doc_id, e] = 1
            upto = 0
            for x in sorted(own, key=lambda x: hashlib.md5(f"{mixing.SEED}:{whole}:{x.doc_id}".encode()).hexdigest()):
                upto += len(x.text.split())
                if upto > left:
                    break
                want[x.doc_id, whole] = 1
        got = rows(mixing.mix(docs, F.col("all_tokens") * share, epochs), "doc_id", "epoch")
        assert got == sorted(want, key=repr)
        assert mixing.mixed(docs, F.col("all_tokens") * share, epochs).select("doc_id", "row").count() == len(want)
    assert mixing.mixed(odd, F.col("all_tokens"), 1).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_fingerprints(spark, odd):
    texts = near_copies(3, 60)
    docs = table(spark, list(texts.values()), list(texts)).repartition(3)
    got = {x.doc_id: x for x in fingerprint.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        x = got[i]
        a, b = fingerprint.Multiset(t), fingerprint.Multiset(edited)
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex())
        assert x.near_edited == fingerprint.likeness(a, b) and x.near_next == fingerprint.likeness(a, fingerprint.Multiset(after))
    assert fingerprint.fingerprints(odd).count() == odd.count()
    assert fingerprint.fingerprints(docs.where("doc_id = 5")).head().near_next == 1.0
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0


def test_fingerprints_are_homomorphic():
    whole = fingerprint.Multiset("one two three\nfour five\nsix")
    parts = fingerprint.Multiset("six").add("four five").add("one two three").add("gone").remove("gone")
    assert whole.hex() == parts.hex() and fingerprint.Multiset.from_hex(whole.hex()).hex() == whole.hex()
    assert fingerprint.likeness(whole, fingerprint.Multiset("nothing like it")) < 0.3 and fingerprint.likeness(whole, whole) == 1
