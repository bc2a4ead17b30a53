"""The llm operators on small fixtures, against brute force, exact round trips and held-out labels."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakebranch.llm import chat, components, decontamination, fingerprints, html_extract, lm_score, mixing, ngram_join, queries, shared, textops, token_counts, toxicity, warc
from lakebranch.llm.dom import parse
from lakebranch.llm.textops import column_words, distinct, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a b c d e f g h", "en", "s1", 15), (2, None, None, None, None), (3, "", "en", "s2", 0), (None, "x y", "en", None, 3), (4, "a b c d e f g h", "en", "s1", 15), (4, "a b c d e f g h", "en", "s1", 15),
    (5, "word " * 30_000, "en", "s3", 150_000), (6, "é" * 5_000, "fr", "s2", 5_000), (7, "one", "en", "s1", 3), (8, "\t \n", "en", "s1", 3), (9, "A b C d e f g i", "en", "s4", 15),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names used inside."""
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.withColumns({"id": F.lit("x"), "size": F.lit(1), "row": F.lit(2), "class": F.lit(3), "bucket": F.lit(0), "score": F.lit(0.1)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets(texts, n=5):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def test_shingles_by_brute_force():
    texts = [r[1] for r in ODD]
    owner, _, _ = distinct(*shingles(column_words(pa.array(texts, pa.string())), 5))
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(s) for s in sets(texts)]


def test_fingerprints_estimate_weighted_jaccard():
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(100, 500))
    one = fingerprints.signatures(*fingerprints.terms(pa.array([a, b, a])), 3, 512)
    counts = [Counter(tuple(words(t)[max(0, i - 4) : i + 1]) for i in range(400)) for t in (a, b)]
    true = sum((counts[0] & counts[1]).values()) / sum((counts[0] | counts[1]).values())
    assert abs(fingerprints.likeness(one[:1], one[1:2])[0] - true) < 0.09 and (one[0] == one[2]).all()
    heavy = fingerprints.signatures(*fingerprints.terms(pa.array(["q " * 40, "q " * 20])), 2, 512)
    assert 0.3 < fingerprints.likeness(heavy[:1], heavy[1:2])[0] < 0.65


def brute_likeness(a, b, k=fingerprints.SAMPLES):
    """Consistent weighted sampling of two texts term by term, in plain Python but for the hashes that random values are read off."""
    picks = []
    for text in (a, b):
        owner, term, weight = fingerprints.terms(pa.array([text]))
        sample = []
        for j in range(k):
            least = None
            for x, w in zip(term.tolist(), weight.tolist(), strict=True):
                salted = np.array([x], np.uint64) ^ textops.mix(np.array([j + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                u = textops.mix(salted).view(np.uint16).astype(float)
                beta = float((salted * np.uint64(0xD6E8FEB86659FD93))[0] >> np.uint64(40)) / 2**24
                log = lambda i, u=u: -np.log((u[i] + 0.5) / 65536)
                r, c = log(0) + log(1), log(2) + log(3)
                t = np.floor(np.log(w) / r + beta)
                value = c * np.exp(-r * (t + 1 - beta))
                if least is None or value < least[0]:
                    least = (value, x, t)
            sample.append(least and least[1:])
        picks.append(sample)
    return np.mean([x == y for x, y in zip(*picks, strict=True)])


def test_edited_pairs(spark, odd, none, docs):
    strings = spark.createDataFrame([(x, f"t {x} " * 3) for x in "b a é c d".split()] + [("a", "q"), (None, "n")], "doc_id string, text string")
    few = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(i + 5))) for i in range(12)] + [(12, ""), (13, None)], "doc_id smallint, text string")
    for df in (docs, odd, strings, few, docs.limit(1), spark.createDataFrame([(float("nan"), "a b"), (1.5, "c"), (None, "d")], "doc_id double, text string")):
        given = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
        rows = [(r.doc_id, r.text) for r in sorted(given, key=lambda r: fingerprints.key_of(r.doc_id, r.h), reverse=True)]
        want = Counter()
        for i, (d, x) in enumerate(rows):
            y, k = rows[(i + 1) % len(rows)][1], len(x) // 3
            want[str(d), len(x), hashlib.sha256((x[: len(x) - k] + y[:k]).encode()).hexdigest()] += 1
        got = fingerprints.edited_pairs(df).collect()
        assert Counter((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        if df is few:
            for i, (d, x) in enumerate(rows):
                y = rows[(i + 1) % len(rows)][1]
                (r,) = [r for r in got if r.doc_id == d]
                assert abs(r.near_edited - brute_likeness(x, x[: len(x) - len(x) // 3] + y[: len(x) // 3])) < 0.02 and abs(r.near_next - brute_likeness(x, y)) < 0.02
    assert fingerprints.edited_pairs(none).count() == 0
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in fingerprints.edited_pairs(docs).collect())


def brute_groups(rows):
    found, up = sets([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(found):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(found):
        for j, k in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * k >= 75 * (len(s) + len(found[j]) - k):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, found, strict=True)))


def test_similar_groups(spark, odd, none, docs):
    base = [f"w{i}" for i in range(120)]
    near = []
    for i in range(60):  # near copies of one text, some too far from it
        w = list(base)
        for j in range(i % 9):
            w[(i * 13 + j * 29) % 120] = f"v{i}_{j}"
        near.append((1000 + i, " ".join(w)))
    made = spark.createDataFrame(near, "doc_id long, text string")
    for df in (docs, odd, made):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect())
        assert got == brute_groups(rows)
    assert ngram_join.similar_groups(none).count() == 0


def test_groups_of_copies_in_several_partitions(spark):
    text = " ".join(f"w{i}" for i in range(10))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for rows in ([(1, text), (2, text)], [(3, text), (3, text), (None, text), (4, "one word"), (5, None)]):
                df = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
                got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect())
                assert got == brute_groups(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_words_in_pieces(monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["", "x" * 300, None, "A" * 64 + " " + "b" * 65, " " * 200, *("".join(rng.choice(list("abAB é\t."), rng.integers(1, 300))) for _ in range(80)), "y" * 700]
    column = pa.array(texts)
    for longest in (0, 7, 24):
        for gap in (textops._SPACE, textops.MARKS):
            whole = textops.words(*textops.buffers(column), longest, gap, (4, 9))
            with monkeypatch.context() as m:
                m.setattr(textops, "PIECE", 64)
                cut = textops.words(*textops.buffers(column), longest, gap, (4, 9))
            for name in ("first", "hashes", "starts", "ends"):
                assert np.array_equal(getattr(whole, name), getattr(cut, name))
            assert all(np.array_equal(whole.heads[n], cut.heads[n]) for n in (4, 9))
    plain = textops.words(*textops.buffers(column))
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", texts[5].encode())]
    assert int(plain.counts[5]) == len(spans)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["class"]: r.root for r in components.roots(edges, spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 7_000]], "class long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[7_000] == 7_000


def test_lm_scores(spark, odd, none):
    rows = [r for r in ODD if len(r[1] or "") < 1000]
    texts = [words(r[1]) for r in rows]
    total = [Counter(tuple(w[i - n + 1 : i + 1]) for w in texts for i in range(n - 1, len(w))) for n in (1, 2, 3)]
    want = Counter()
    for r, w in zip(rows, texts, strict=True):
        own = [Counter(tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w))) for n in (1, 2, 3)]
        c = lambda *g: total[len(g) - 1][g] - own[len(g) - 1][g]
        n, score = sum(map(len, texts)) - len(w), 0.0
        for i in range(len(w)):
            top = min(3, i + 1)
            for k in range(top, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if c(*g) > 0:
                    score += np.log(c(*g) / (c(*g[:-1]) if k > 1 else n)) + (top - k) * np.log(0.4)
                    break
            else:
                score += top * np.log(0.4) - np.log(n + 1)
        want[r[0], len(w), round(score, 6)] += 1
    got = lm_score.lm_scores(odd.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)")).collect()
    assert len(lm_score.lm_scores(odd).collect()) == len(ODD)
    assert {(r.doc_id, r.n_words) for r in got} == {(d, n) for d, n, _ in want} - {(6, 1)}
    again = lm_score.lm_scores(spark.createDataFrame([r for r in ODD if len(r[1] or "") < 1000], DOCS)).collect()
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in again) == want
    assert lm_score.lm_scores(none).count() == 0
    shuffled = spark.createDataFrame([r for r in ODD if len(r[1] or "") < 1000], DOCS).repartition(3).orderBy(F.rand())
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score.lm_scores(shuffled).collect()) == want
    x = np.array([0, 5, 2**40, 2**63], dtype=np.uint64)
    assert (lm_score.unpacked(lm_score.packed(x, x[:0]))[0] == x).all()


def test_mix(spark, odd, none, docs):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
        by = defaultdict(lambda: [0, 0, 0.0, 0])
        for r in rows:
            s = by[r.source]
            s[0], s[1], s[2], s[3] = s[0] + r.size, s[1] + r.taken, r.target, max(s[3], r.size)
        assert abs(sum(s[2] for s in by.values()) - sum(s[0] for s in by.values())) < 1e-6
        assert all(s[2] <= 3 * s[0] + 1e-9 and abs(s[1] - s[2]) <= s[3] / 2 + 1e-9 for s in by.values())
        assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(df).collect()))
    assert mixing.mix(none).count() == 0


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}\r\nx", f"<p>page {i % 40} " + "text " * (i % 7) + "</p>") for i in range(300)] + [(900, None, None), (901, "u", ""), (None, "v", "<p>only</p>"), (902, "w", "é" * 200_000), (902, "w", "é" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    made = warc.write_archives(df, shared.new_path(spark, "warc"))
    got = warc.read_archives(made, payloads=True).collect()
    assert Counter((r.id, r.url) for r in got) == Counter((i, u or "") for i, u, _ in rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(-1 if i is None else i, last.get(h or "", -1))
    html = {(i, u or ""): h or "" for i, u, h in rows}
    for r in got:
        own = html[r.id, r.url]
        best = last[own]
        response = (-1 if r.id is None else r.id) == best
        assert r.record_type == ("response" if response else "revisit") and r.refers_to == (None if response else best)
        assert r.payload_bytes == len(own.encode()) and (not response or r.payload.decode() == own)
    assert warc.write_archives(df.limit(0), shared.new_path(spark, "warc")).count() == 0


def test_every_archive_has_a_dictionary(spark, tmp_path):
    page = lambda i: f"<html><body><p>page {i}</p>{''.join(f'<p>{hashlib.sha256(f'{i},{j}'.encode()).hexdigest()}</p>' for j in range(20))}</body></html>"
    for kind, pages in (("raw", [page(0)]), ("raw", ["", ""]), ("raw", ["é" * 90_000]), ("trained", [page(i) for i in range(400)])):
        path = tmp_path / "one.warc.zst"
        archive = warc.Archive(path.open("wb"))
        for i, p in enumerate(pages):
            archive.add(warc.record(str(i), "u", p.encode(), "", "response", None))
        archive.close()
        assert archive.dictionary == kind and int.from_bytes(path.read_bytes()[:4], "little") == warc.MAGIC
        with path.open("rb", buffering=0) as stream:
            assert [payload.decode() for *_, payload in warc.read_archive(stream)] == pages
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    assert [(r.records, r.dictionary) for r in warc.write_archives(df, shared.new_path(spark, "warc")).collect()] == [(1, "raw")]


def word_features(word):
    """The places of a word's weights: of the whole and of its beginnings, hashed in plain integers."""
    base, mask = 0x9E3779B97F4A7C15 | 1, 2**64 - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def hashed(b):
        return mixed(sum((c + 1) * pow(base, i, 2**64) for i, c in enumerate(b)) + len(b) * 0xA0761D6478BD642F & mask)

    data = word.lower().encode()
    return [mixed(hashed(data)) >> 46, *(mixed((hashed(data[:n]) + n & mask) if len(data) > n else hashed(data)) >> 46 for n in toxicity.PREFIXES)]


def test_toxicity_learns_sentences(spark, odd, none):
    rng = np.random.default_rng(0)
    pool = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        lines = [" ".join(rng.choice(pool, 8)) for _ in range(rng.integers(1, 6))]
        bad = i % 4 == 0
        if bad:
            lines[rng.integers(len(lines))] += " you utter " + rng.choice(["clodpate", "numbskull"])
        rows.append((i, ". ".join(lines) + "."))
        marks.append((i, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.fit(df, labels.filter(~queries.held_out(F.col("doc_id"))))
    got = toxicity.score(df, model).select("row.*", "score", "offending").collect()
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if held(r.doc_id)]
    assert np.mean(right) > 0.95
    for r in got:
        for s in r.offending:
            assert re.search("clodpate|numbskull|utter|you", r.text[s.start : s.end])
    for r in got[:50]:  # noisy-or of sentences, by the plain formula
        product = 1.0
        for line in re.split(r"[.!?\n\r]", r.text):
            if found := re.findall(r"[A-Za-z0-9]+", line):
                product *= 1 - 1 / (1 + math.exp(-model.bias - sum(float(model.weights[f]) for w in found for f in word_features(w))))
        assert abs(r.score - (1 - product)) < 1e-5
    small = toxicity.fit(df, labels, rows=100, size=3_000)
    assert small.weights.any() and toxicity.fit(df.unionByName(df), labels, rows=10).weights.shape == small.weights.shape
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out) and toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels).weights.any() == False  # noqa: E712


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b \\<| <|end|> \\| \\\\"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "assistant", ""), (3, None, "assistant", "x\ny"), (3, 2, "assistant", "<|start|>"), (None, 0, "user", "z"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    done = chat.format_chats(df).withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    for r in done.collect():
        own = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
    # a very long conversation of many turns, and parts of every kind in many orders
    many = [(9, i, "assistant" if i % 2 else "user", f"<|end|> \\ {i} " * 2_000) for i in range(60)]
    long = chat.format_chats(spark.createDataFrame(many, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text"))))
    r = long.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t.text for t in r.turns] == [x[3] for x in many] and r.loss == "".join(x[3] for x in many if x[2] == "assistant")
    parts = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    typed = spark.createDataFrame([(1, 0, "user", [("text", "see", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 2), ("text", "<|end|>", None, None, None, None, None)])], f"conv_id long, turn long, role string, parts {parts}")
    r = chat.format_chats(typed).first()
    assert "see<|image:1|><|audio:2|><|document:3|><\\|end|>" in r.formatted
    kinds = {"image": ("i", 56, 29, None, None, 4), "audio": ("a", None, None, 1.5, None, 38), "document": ("d", None, None, None, 2, 1_200)}
    mixed = [["audio", "image"], ["text", "document", "document", "text"], [], ["image"] * 5 + ["text"], ["text", "text"], ["document", "audio", "text", "image"]]
    turns = [(1, i, "user", [(k, "t<|", None, None, None, None, None) if k == "text" else (k, None, *kinds[k][:5]) for k in row]) for i, row in enumerate(mixed)]
    m = chat.format_chats(spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {parts}")).first()
    want = [(i, n, k, kinds[k][0], kinds[k][5]) for i, row in enumerate(mixed) for n, k in enumerate(row) if k != "text"]
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in m.attachments] == want and m.attachment_tokens == sum(w[4] for w in want)
    assert [(k, int(n)) for k, n in re.findall(r"<\|(image|audio|document):(\d+)\|>", m.formatted)] == [(w[2], w[1]) for w in want] and m.formatted.count("t<\\|") == 6
    assert [(a.part, a.ref, a.tokens) for a in r.attachments] == [(1, "i.png", 4), (2, "a.wav", 38), (3, "d.pdf", 1200)] and r.attachment_tokens == 1242


def test_token_counts_are_the_librarys(spark, odd, none, docs):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = vocabularies.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    for df in (docs, odd):
        want = Counter((r.doc_id, len((r.text or "").encode()), count(r.text)) for r in df.collect())
        assert Counter(map(tuple, token_counts.token_counts(df, path).collect())) == want
    assert token_counts.token_counts(none, path).count() == 0
    c = token_counts.Counts(path)
    for t in ("<|endoftext|>", "a<|endoftext|> b", " \n\n x  y", "it's 'll 123abc", "՘x \U0001df2b", "\x1c\x85　a"):
        assert c.count(t) == count(t)


def test_frequent_table_of_an_ordered_table(spark):
    pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [("first words",)] * 100 + [("second lines",)] * 3_900
    table = token_counts.frequent_table(spark.createDataFrame(rows, "text string").coalesce(1), path)
    assert {"second", " lines"} <= set(table)


def brute_overlap(item, text):
    """The most agreeing words, and the least stretch with them, over all diagonals with a seed and all stretches that meet the rule."""
    if len(item) < 5:
        return (len(item), len(item)) if item and item == text else None
    best, least = (0, 0), min(12, -(-7 * len(item) // 10))
    for start in range(1 - len(item), len(text)):
        same = {i: item[i] == text[start + i] for i in range(len(item)) if 0 <= start + i < len(text)}
        if not any(all(same.get(i + j, False) for j, bit in enumerate(m) if bit == "1") and i + len(m) - 1 in same for m in decontamination.MASKS for i in same):
            continue
        for i in same:
            agree = 0
            for j in range(i, max(same) + 1):
                agree += same[j]
                if agree >= least and 10 * agree >= 7 * (j + 1 - i):
                    best = max(best, (agree, i - j - 1))
    return (-best[1], best[0]) if best[0] else None


def test_overlaps_by_brute_force(spark, odd, none):
    rng = np.random.default_rng(1)
    pool = [f"t{i}" for i in range(5_000)]
    items = [(i, " ".join(rng.choice(pool, n))) for i, n in enumerate([40, 20, 15, 4, 1, 8])] + [(20, "word " * 30), (21, "b c d e f G h"), (22, "one"), (23, "x y z"), (None, "a b c d e f g i"), (24, "q r " * 9), (50, None), (51, ""), (2, "one")]
    changed = items[0][1].split()
    for j in range(4, 40, 6):
        changed[j] = "zz"
    filler = lambda: " ".join(rng.choice(pool, 50))
    rows = [
        (1, f"{filler()} {' '.join(changed)} {filler()}"), (2, f"{filler()} {items[1][1].upper()}"), (3, filler()), (4, f"x {items[3][1]} y"), (4, items[3][1]), (5, " ".join(items[0][1].split()[:6]) + " " + filler()),
        (6, None), (7, items[4][1]), (8, "the " + items[4][1]), (9, "r q " * 20), (10, f"{items[5][1]} {items[1][1]}"), (11, "X y Z"), (None, items[1][1]), (12, "word " * 9), (13, " ".join(items[5][1].split()[:5])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    small = spark.createDataFrame([r[:2] for r in ODD if len(r[1] or "") < 1_000], "doc_id long, text string")
    for df in (spark.createDataFrame(rows, "doc_id long, text string").repartition(5), small):
        given = [(r.doc_id, r.text) for r in df.collect()]
        want = Counter((d, i, *best) for d, t in given for i, x in items if (best := brute_overlap(words(x), words(t))))
        got = decontamination.overlaps(df, bench).collect()
        assert Counter((r.doc_id, r.item_id, r.n_words, r.n_agreeing) for r in got) == want and sum(want.values()) > 2
        text_of = defaultdict(list)
        for d, t in given:
            text_of[d].append(words(t))
        for r in got:
            item = [set(words(x)) for i, x in items if i == r.item_id]
            assert any(sum(w in s for w in t[r.start_word : r.start_word + r.n_words]) >= r.n_agreeing for t in text_of[r.doc_id] for s in item)
        flagged = {t for _, t in given if any(brute_overlap(words(x), words(t)) for _, x in items)}
        assert Counter(map(tuple, decontamination.clean(df, bench).collect())) == Counter(r for r in given if r[1] not in flagged)
    assert decontamination.clean(odd, bench).columns == odd.columns and {r.doc_id for r in decontamination.overlaps(odd.filter("doc_id = 5"), bench).collect()} == {5}
    assert decontamination.overlaps(none, bench).count() == 0 and decontamination.clean(none, bench).count() == 0
    assert decontamination.overlaps(odd, bench.limit(0)).count() == 0 and decontamination.clean(odd, bench.limit(0)).count() == len(ODD)
    named = spark.createDataFrame([("a", items[1][1])], "doc_id string, text string")
    assert [tuple(r) for r in decontamination.overlaps(named, spark.createDataFrame([(7, items[1][1])], "item_id smallint, text string")).collect()] == [("a", 7, 0, 20, 20)]


def as_words(text):
    return column_words(pa.array([" ".join(text)], pa.string())).hashes


def test_any_stretch_of_an_overlap_counts():
    rng = np.random.default_rng(4)
    cases = []
    for rate in (0.2, 0.25, 0.3, 0.35):
        for _ in range(100):
            cases.append((rng.random(rng.integers(15, 60)) >= rate).tolist())
    planned = [[5, 3, 5, 3, 5, 3, 5], [20, 13, 20, 13, 20]]
    cases += [[k % 2 == 0 for k, n in enumerate(runs) for _ in range(n)] for runs in planned]
    found = []
    for same in cases:
        item = [f"t{i}" for i in range(len(same))]
        text = [f"f{i}" for i in range(9)] + [w if s else f"x{i}" for i, (w, s) in enumerate(zip(item, same, strict=True))] + ["f"] * 9
        got = decontamination.overlap(as_words(text), as_words(item))
        found.append(brute_overlap(item, text))
        assert (got and got[1:]) == found[-1]
        if got:
            assert sum(a in item for a in text[got[0] : got[0] + got[1]]) == got[2]
    assert found[-2:] == [(21, 15), (53, 40)] and None in found


def test_repeated_words_overlap_in_little_time():
    rng = np.random.default_rng(5)
    for _ in range(60):  # few different words, so that a seed hits on many diagonals; the dense way too
        item, text = ([str(x) for x in rng.integers(0, 2, n)] for n in (rng.integers(5, 30), rng.integers(5, 60)))
        for dense in (decontamination.DENSE, 0):
            decontamination.DENSE, kept = dense, decontamination.DENSE
            got = decontamination.overlap(as_words(text), as_words(item))
            decontamination.DENSE = kept
            assert (got and got[1:]) == brute_overlap(item, text)
    began = time.time()
    assert decontamination.overlap(as_words(["word"] * 30_000), as_words(["word"] * 1_000)) == (0, 1_000, 1_000)
    assert decontamination.overlap(as_words(["a", "b"] * 15_000), as_words(["b", "a"] * 500)) == (1, 1_000, 1_000)
    assert time.time() - began < 20


def test_extraction(spark, folder):
    from lakebranch.llm.page_labels import HELD_OUT, labelled_pages

    model = html_extract.trained()
    wrong = lambda layouts: sum(html_extract.main_texts([page], model) != ["\n".join(blocks)] for page, blocks in labelled_pages(60, seed=5, layouts=layouts))
    assert wrong(("",)) <= 7 and all(wrong((layout,)) <= 2 for layout in HELD_OUT)  # whole texts, with order and repeats
    kept = "<p>Energy is <math><mi>E</mi></math> here.</p><noscript><p>In noscript.</p></noscript><object><p>In object.</p></object><details><summary>More on it</summary><p>Hidden details text.</p></details><p>The end of it, at last.</p>"
    text = "Energy is E here.\nIn noscript.\nIn object.\nMore on it\nHidden details text.\nThe end of it, at last."
    frame = "<nav><a href=/>Home</a> <a href=/b>B</a></nav><article>{}</article><footer>&copy; me</footer>"
    assert html_extract.main_texts([f"<article>{kept}</article>", frame.format(kept), "<p>A lone paragraph.</p>"], model) == [text, text, "A lone paragraph."]
    assert html_extract.main_texts([frame.format("<p>a b c.</p><noscript><p>d e f.</p><p>g h i.</p>")], model) == ["a b c.\nd e f.\ng h i."]
    again = "<p>The same line, twice.</p>" * 2 + "<p>Then another one.</p>" + "<p>The same line, twice.</p>"
    assert html_extract.main_texts([frame.format(again)], model) == ["The same line, twice.\nThe same line, twice.\nThen another one.\nThe same line, twice."]
    page = "<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One  two\nthree<br>four<p>Five</article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<" * 50_000), (5, "u", "<div>" * 3_000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[1] == "T & U\nOne two three four\nFive" and got[2] == got[3] == ""
    assert html_extract.extract(df).count() == 6 and html_extract.extract(df.limit(0)).count() == 0


def test_only_hidden_elements_have_no_text():
    blocks = lambda page: [n.text for n in parse(page) if n.text]
    assert blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert blocks("<p>a</p><svg><path d='M0'/><text>label</text><style>b</style></svg><p>c</p>") == ["a", "label", "c"]
    assert blocks("<p>a</p><xmp><b> &amp;</xmp><p>c</p>") == ["a", "<b> &amp;", "c"]
    for tag in "svg math object video audio canvas xmp".split():
        assert blocks(f"<article><p>a <{tag}> b</p><p>c</p></article><footer>d</footer>") == ["a b", "c", "d"]
    assert blocks("<p>a <noscript>b</noscript> c</p><noscript>d<p>e</noscript>f") == ["a b c", "d", "e", "f"]
    for tag in "script style title textarea template iframe noembed noframes".split():
        assert blocks(f"<p>a</p><{tag}>b</{tag}><p>c</p>") == ["a", "c"]


def test_marginals_by_enumeration():
    f = html_extract.forest([parse("<div><p>a</p><p>b</p></div>")])
    rng = np.random.default_rng(2)
    m = html_extract.Model(rng.normal(size=html_extract.N_FEATURES), rng.normal(size=(len(html_extract.KINDS), 2, 2)))
    n, own = len(f.parent), f.features @ m.weights
    total, on = 0.0, np.zeros(n)
    for bits in range(1 << n):
        x = [bits >> i & 1 for i in range(n)]
        w = np.exp(sum(own[i] * x[i] for i in range(n)) + sum(m.edges[f.kind[i], x[f.parent[i]], x[i]] for i in range(1, n)))
        total, on = total + w, on + w * np.array(x)
    assert np.allclose(m.marginals(f)[0], on / total)


def test_pipeline_keeps_clean_documents(spark, folder, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing"]
    kept = corpus_pipeline.one_of_each_group(spark, docs, folder)
    groups = {r.component_id for r in ngram_join.similar_groups(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == groups and kept.columns == docs.columns
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and 0 < out.count() <= len(groups)


def test_one_row_of_each_group_stays(spark, odd, none):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (1, a), (2, a + " z"), (None, a), (None, b), (None, b + " z"), (3, b), (1, "c d"), (None, None), (None, ""), (4, "e f"), (None, "q r"), (None, "q r")]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "row": F.lit(2), "last": F.lit(3)})
    kept = corpus_pipeline.one_of_each_group(spark, made, "")
    assert kept.columns == made.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (3, b), (1, "c d"), (None, None), (None, ""), (4, "e f"), (None, "q r")])
    got = corpus_pipeline.one_of_each_group(spark, odd, "").collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 2, 3, None, 5, 6, 7, 8, 9])
    assert corpus_pipeline.one_of_each_group(spark, none, "").count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    pool = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(pool, n))
    passage = text(40)
    rows = []
    for i in range(400):
        lines = [text(10) for _ in range(3)]
        rows.append((i, ". ".join(x + " you utter clodpate numbskull" if i % 4 == 0 else x for x in lines) + ".", f"s{i % 3}"))
    long = [text(60) for _ in range(6)]
    near = lambda t: t + " zz"
    changed = " ".join("zz" if j % 5 == 4 else w for j, w in enumerate(passage.split()))
    rows += [(1000, long[0], "s0"), (1000, long[0], "s0"), (1001, near(long[0]), "s1"), (None, long[0], "s0"), (None, long[1], None), (None, near(long[1]), None)]
    rows += [(1002, f"{long[2]} {passage}", "s1"), (1003, f"{changed} {long[3]}", "s2"), (1004, f"{long[4]} {' '.join(passage.split()[:6])}", "s2"), (1005, None, "s0"), (1006, "", None), (None, None, "s1"), (1007, long[5], "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit(1), "n": F.lit(2), "score": F.lit(0.9)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, passage), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    clean = [r for r in rows if "clodpate" not in (r[1] or "")]
    root = {}
    for r in sorted(clean, key=lambda r: (r[0] is None, r[0] or 0)):  # the first of those in a group that it links to stays
        s = sets([r[1]])[0]
        if not s or not any(4 * len(s & o) >= 3 * len(s | o) for o, _ in root.values()):
            root[len(root)] = (s, r)
    kept = [r for _, r in root.values() if not brute_overlap(passage.split(), words(r[1]))]
    assert len(kept) == 300 + 7 and len(clean) == len(rows) - 100
    sizes = Counter()
    for _, t, source in kept:
        sizes[source] += len(words(t))
    want = Counter((d, source, len(words(t)), sizes[source]) for d, t, source in kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.source_size) for r in got) == want
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken in [k * r.size for k in range(4)]
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[r.source] - r.target) <= max(x.size for x in got if x.source == r.source) / 2 + 1e-9 for r in got)

    empty = f"{tmp_path}/empty"
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{table}.parquet").write.parquet(f"{empty}/{table}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name
