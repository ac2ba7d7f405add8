"""Each operator against a plain version of what it must compute, and on awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import chat, hamming, licenses, linededup, packing, quality, queries, semantic, setjoin, urls, warc
from palimpsest.llm._util import components

DOCS = "doc_id long, text string, lang string, component_id string, score string, n_lines string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, and columns whose names clash with results'."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, long), (6, "one two"), (7, "one two"), (8, "a b c d e f g"), (8, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (9, "x" * 100_000)]
    return spark.createDataFrame([(d, t, "en", "c", "s", "n") for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(4000, 4300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, odd, none):
    tok = Tokenizer.from_file(queries.TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd.select("doc_id", "text", "lang")):
        got = packing.pack(df, queries.TOKENIZER).toPandas()
        want = []
        for r in df.collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
            want += [(-1 if r.doc_id is None else r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
        have = got.assign(doc_id=got.doc_id.fillna(-1)).astype("int64")
        assert sorted(map(tuple, have[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
        g = got.sort_values(["sequence_id", "offset"])
        assert (g.groupby("sequence_id").length.sum() <= 2048).all()
        assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    assert packing.pack(none, queries.TOKENIZER).count() == 0
    clash = odd
    for name in ("part", "local", "length", "piece", "sequence_id", "offset", "n", "ahead"):
        clash = clash.withColumn(name, F.lit("x"))
    assert packing.pack(clash, queries.TOKENIZER).columns == packing.pack(odd, queries.TOKENIZER).columns


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_those_of_the_tokenizer(name):
    path = queries.public_tokenizers.path(name)
    plain, ids = Tokenizer.from_file(path), packing._Ids(path, most=5)
    texts = ["Don't 'S it's' x'LL a'b' ''s", "A<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "É. É, é*** ÑÖ ñö, ÿ µ ª º ß", "ΣΑΣ. İx ǅa. K ²³, x²! a\u0338! !\u0338 x\u0301, 中文, 1,2.3% A_b_", "a\u00a0b,\u3000c \t\r\n\n", "", " ", "\n", ",", "z" * 3000 + "," * 300]
    for text in [*texts, " ".join(texts)] * 2:
        assert np.frombuffer(ids.of(text), np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_is_tight():
    rnd = random.Random(1)
    for _ in range(5):
        hist = {}
        for _ in range(3000):
            n = min(2048, int(rnd.lognormvariate(5.5, 1)) + 1)
            hist[n] = hist.get(n, 0) + 1
        plan = packing.solve(hist, 2048, rounds=40)
        used: dict = {}
        for config, times in plan:
            assert sum(n * a for n, a in config.items()) <= 2048
            for n, a in config.items():
                used[n] = used.get(n, 0) + a * times
        assert used == hist
        assert sum(t for _, t in plan) <= -(-sum(n * c for n, c in hist.items()) // 2048) * 1.01 + 1


def test_the_program_places_the_pieces():
    """The share that the rounded program itself places, and its bound, on histograms of few and of many pieces."""
    rnd = random.Random(6)
    hist: dict = {}
    for _ in range(6000):
        n = min(2048, int(rnd.lognormvariate(5.8, 1.2)) + 1)
        hist[n] = hist.get(n, 0) + 1
    for times in (1, 300):
        found = packing.solution({n: c * times for n, c in hist.items()}, 2048)
        used = sum(k for _, k in found.plan)
        assert found.by_program >= 0.9 * found.pieces > 0 and found.bound <= used <= 1.01 * found.bound + 1
    for small, most in (({5: 1}, 1), ({1: 10_000}, 5), ({1025: 7, 1024: 3}, 9), ({2047: 5, 1: 2, 2048: 2}, 7), ({}, 0)):
        assert sum(k for _, k in packing.solution(small, 2048).plan) == most


def test_licenses(spark, duck, odd, none):
    same_rows(queries.op2_license_scan(spark, SF), duck, queries.OP2_SQL)
    text = licenses.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + text.upper()), (2, text.replace(",", "").replace("sublicense", "sublicence")), (3, text + " more"), (4, None), (5, "")]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_licenses_within_texts(spark, duck):
    """Licences that stand among other paragraphs, notices that are lines, neighbouring spellings and clashing columns."""
    found = duck.execute(f"select count(*) from ({queries.OP2_SQL}) where contained <> ''").fetchone()[0]
    assert found > 0
    mit, zlib_, header = (licenses.KNOWN[k] for k in ("MIT", "Zlib", "Apache-2.0 header"))
    rows = [(1, f"# about\n\n{mit}\n \n\t\nthe end"), (2, "x\nReleased under the MIT license\ny"), (3, mit.split("\n\n")[0]), (4, f"{header}\n\n{zlib_}"), (None, mit), (None, None), (5, " ".join(["licence"] * 3))]
    df = spark.createDataFrame([(d, t, "a", "b", "c", 7) for d, t in rows], "doc_id long, text string, digest string, license_id string, contained string, _row long")
    got = licenses.scan(df).collect()
    assert sorted((str(r.doc_id), r.license_id, tuple(r.contained), r["_row"]) for r in got if r.doc_id) == [("1", None, ("MIT",), 7), ("2", None, ("MIT notice",), 7), ("3", None, (), 7), ("4", None, ("Apache-2.0 header", "Zlib"), 7), ("5", None, (), 7)]
    assert {(r.license_id, tuple(r.contained)) for r in got if r.doc_id is None} == {("MIT", ("MIT",)), (None, ())}
    same = licenses.scan(spark.createDataFrame([(1, "licence licences licence"), (2, "license Licenses, LICENSE")], "doc_id long, text string")).collect()
    assert same[0].digest == same[1].digest


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows) > 0
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.collect())
    assert quality.classify(odd, labels).count() == odd.count() and quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs.limit(5), labels.where("false")).collect()} == {1.0}


def test_quality_is_the_fit_of_preferences():
    """The learned weights against plain descent on all pairs, and the cut against every other cut."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 4))
    y = (x @ [1.5, -1.0, 0.5, 0.0] + 0.7 * rng.standard_normal(60) > 0).astype(int)
    model = quality.learn(x, y, pairs=200_000)
    z = (x - x.mean(0)) / (x.std(0) + 1e-3)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    w = np.zeros(4)
    for _ in range(4000):
        w -= 0.5 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) / len(d) + 1e-3 * w)
    assert np.abs(model.weight - w).max() < 0.05 * np.abs(w).max()
    raw = z @ model.weight
    errors = lambda cut: int(((raw >= cut) != y).sum())
    assert errors(model.cut) == min(errors(c) for c in [*raw, raw.max() + 1])
    assert ((model.score(x) >= quality.CUT) == (raw >= model.cut)).all()


def test_quality_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "Good words stand here, line by line.", "a"), (1, "$$$ %% $$$ %%", "a"), (4, "%%% $$$ %%% $$$", "a"), (4, "%%% $$$ %%% $$$", "a"), (None, None, "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 5 and [r.held_out for r in out if r.doc_id is None] == [None] and len({r.score for r in out if r.doc_id == 4}) == 1


@pytest.mark.parametrize("few,local", [(4, 64), (2, 3)])
def test_jaccard_join(spark, odd, none, few, local):
    rnd = random.Random(few)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rnd.choice(vocabulary) for _ in range(40)]
    rows = []
    for family in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 12, 30, 80]))] + (common if family % 3 == 0 else [])
        for _ in range(rnd.choice([1, 2, 8, 30])):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(df, few=few, local=local).collect()}
    assert got == brute_components(rows)
    if few == 4:
        out = setjoin.jaccard_components(odd).collect()
        assert len(out) == odd.count() and all(r.component_id == r.doc_id for r in out if r.n_shingles == 0)
        assert {r.doc_id: r.component_id for r in out if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9}
        assert setjoin.jaccard_components(none).count() == 0


def test_jaccard_join_of_texts_that_share_a_doc_id(spark):
    """Each text of an id links on its own; an empty one links nothing; rows come back as often as they went in."""
    rnd = random.Random(7)
    a, b, c = ([f"{x}{rnd.randrange(900)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:-2], "other", "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (4, ""), (4, None), (4, ""), (5, near(c)), (5, near(c)), (6, ""), (None, near(b)), (None, None), (0, "q r")]
    got = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = lambda t: max(len(words(t)) - 4, min(1, len(words(t))))
    root = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 0: 0}
    want = [(d, size(t), root[d] if d is not None else 1 if t else None) for d, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_linked_pairs_agree_as_often_as_both_sets_count_on():
    """The second pass: of two sets close to 0.75 with private elements, either expects no more of the other than it has."""
    rng, layouts, memo = random.Random(4), setjoin._Layouts(1.5), setjoin._Hash()
    for t in range(200):
        core, private = rng.randrange(15, 250), rng.randrange(3)
        tails = [(core - 4) // 3 - private, private]
        sets = [setjoin.shingles(" ".join([f"c{t}x{k}" for k in range(core)] + [f"t{t}x{i}x{k}" for k in range(n)]), memo) for i, n in enumerate(tails)]
        held, bought = [], []
        for u in sets:
            of, least = {}, []
            for guest in (0, 1):
                where = layouts.of(u, bool(guest))
                if where:
                    sig, what, segments = setjoin._entries(layouts, u, *where, True)
                    for s, x in zip(sig.tolist(), what.tolist(), strict=True):
                        of.setdefault(s, []).append(x | guest * setjoin.GUEST)
                    least.append(2 * segments)
            held.append(of)
            bought.append(min(least))
        met = [x | y for s in held[0].keys() & held[1].keys() for x in held[0][s] for y in held[1][s] if not x & y & (setjoin.GUEST | setjoin.DELETION)]
        assert sum(1 if x & setjoin.DELETION else 2 for x in met) >= max(bought) - sum(map(len, sets)) // 7


def test_warc(spark, duck, tmp_path):
    same_rows(queries.op5_warc(spark, SF), duck, queries.OP5_SQL)
    long = "é\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, None, None), (4, "http://c/ d", ""), (5, "http://e/", "short"), (6, "http://f/", "short"), (None, "http://g/", long)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", captures_each=2)
    got = {r.page_id: r for r in warc.assemble(warc.read_archives(spark, f"file://{tmp_path}/w")).collect()}
    assert len(got) == len(rows) and all(r.request and r.metadata and r.n_requests == 1 for r in got.values())
    assert bytes(got[1].payload).decode() == long and (got[2].kind, got[2].refers_to) == ("revisit", "<urn:palimpsest:capture:1>")
    assert got[2].payload_bytes == len(long.encode()) and got[2].payload_digest == got[1].payload_digest
    assert [got[k].kind for k in (3, 4, 5, 6)] == ["response"] * 4 and bytes(got[3].payload) == b""
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_warc_of_odd_pages(spark, tmp_path):
    """A capture per row, also of repeated pages; small archives of large pages; empty tables and clashing columns."""
    long, other = "x" * 5000, "y" * 300
    rows = [(1, "http://a/", long), (1, "http://a/", long), (1, "http://a/", other), (2, "http://b/", other), (2, "http://b/", other), (3, None, None), (3, None, None), (None, "http://c/", other), (4, "http://d/", long)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, payload string, row long")
    warc.write_archives(df, f"file://{tmp_path}/w", captures_each=4, archive_bytes=2000)
    got = warc.assemble(warc.read_archives(spark, f"file://{tmp_path}/w", flush=100)).collect()
    assert sorted((str(r.page_id), r.kind, bytes(r.payload)[:1], r.payload_bytes) for r in got) == sorted(
        [("1", "response", b"x", 5000)] * 2 + [("1", "response", b"y", 300)] + [("2", "revisit", b"", 300)] * 2 + [("3", "response", b"", 0)] * 2 + [("None", "response", b"y", 300), ("4", "revisit", b"", 5000)])
    ids = {r.capture for r in got}
    assert len(ids) == len(rows) and all(r.refers_to in ids for r in got if r.kind == "revisit") and all(r.n_requests == r.n_metadata == 1 for r in got)
    sizes = [len(list(warc.parse(f.read_bytes()))) for f in tmp_path.glob("w/*/part-*")]
    assert max(sizes) <= 12 and sum(sizes) == 3 * len(rows)
    warc.write_archives(df.where("false"), f"file://{tmp_path}/e")
    assert warc.assemble(warc.read_archives(spark, f"file://{tmp_path}/e")).count() == 0


def test_line_dedup(spark, odd, none):
    base = "the quick brown fox jumps over the lazy dog and runs along the river bank"
    rows = [(1, f"{base}\nunique line number one stays here\nshort"), (2, f"{base.upper()}\nshort\n{base}!"), (3, "nothing of that is in here at all, so it stays"), (4, None), (5, base.replace("lazy", "hazy")), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.dedup(df).collect()}
    assert got == {1: (rows[0][1], 3, 0), 2: ("short", 3, 2), 3: (rows[2][1], 1, 0), 4: (None, 0, 0), 5: ("", 1, 1), 6: ("", 1, 0)}
    assert linededup.dedup(odd).count() == odd.count() and linededup.dedup(none).count() == 0


def test_line_dedup_recall(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    lines = sorted({(r.doc_id, i, x.strip().lower()) for r in docs.collect() for i, x in enumerate((r.text or "").split("\n")) if len(x.strip().encode()) >= 20})
    dropped = {(r.doc_id, p) for r in linededup.duplicate_lines(docs).collect() for p in r["drop"]}
    sets = [{b[i : i + 8] for i in range(max(1, len(b) - 7))} for b in (x[2].encode() for x in lines)]
    group = list(range(len(lines)))
    for j in range(len(lines)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = {lines[j][:2] for j in range(len(lines)) if group[j] != j}
    assert dropped <= want and len(dropped) >= 0.9 * len(want)


@pytest.mark.parametrize("small", [64, 2])
def test_line_dedup_compares_whole_buckets(spark, small):
    """Clusters of lines in one bucket, of which most are under the threshold to the bucket's ends."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    core, lines = " ".join(word() for _ in range(20)), []
    for _ in range(40):
        own = " ".join(word() for _ in range(4))
        lines += [f"{core} {own}", f"{core} {own} {' '.join(word() for _ in range(5))}"]
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    assert all((100 * len(a & b) >= 75 * len(a | b)) == (i // 2 == j // 2) for i, a in enumerate(sets) for j, b in enumerate(sets))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    dropped = {r.doc_id for r in linededup.duplicate_lines(docs, small=small).collect()}
    assert dropped <= set(range(1, 80, 2)) and len(dropped) >= 39


def test_line_dedup_writes_verified_pairs_only(spark, monkeypatch):
    """Lines of one bucket, each of them apart from all others: what is compared there must not leave the join."""
    rng, real, written = random.Random(6), linededup.materialize, []
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    core = " ".join(word() for _ in range(20))
    lines = [f"{core} {' '.join(word() for _ in range(6))}" for _ in range(120)]

    def spy(df, tag):
        out = real(df, tag)
        if tag in ("pairs", "edges"):
            written.append(out.count())
        return out

    monkeypatch.setattr(linededup, "materialize", spy)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert linededup.duplicate_lines(docs).count() == 0
    assert max(written) < 2 * 6 * 120 and written[-1] == 0


def test_line_dedup_makes_lines_and_sets_once(spark):
    """A condition on a selected column must not make a line, or a pair's shingle sets, again for each mention."""
    docs = spark.createDataFrame([(1, "Abcdefgh ij\n \t\r\n\u4e2d")], "doc_id long, text string")
    lines = linededup._lines(docs, 1, linededup._place(docs))
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert sorted((r.pos, r.line) for r in lines.collect()) == [(0, "abcdefgh ij"), (2, "\u4e2d")]
    texts = spark.createDataFrame([(1, b"abcdefghijkl"), (2, b"abcdefghijklm"), (3, b"abcdefghijxx")], "h long, raw binary")
    found = linededup._verified(texts, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), 8, 75)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 2
    assert found.collect() == [(1, 2)]


def test_line_dedup_sets_are_compiled(spark):
    """Shingle sets of pairs are made by generated code: a generator with a lambda in it is not compiled."""
    texts = spark.createDataFrame([(1, b"abcdefghijkl"), (2, b"abcdefghijklm")], "h long, raw binary")
    found = linededup._verified(texts, spark.createDataFrame([(1, 2)], "a long, b long"), 8, 75)
    (made,) = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate inline" in x]
    assert "array_distinct(" in made and "lambda" not in made
    assert found.collect() == [(1, 2)]


def test_line_dedup_makes_sets_of_lines_with_partners(spark):
    """Of a bucket's lines only those whose minima agree with another's get a shingle set."""
    m, other = list(range(18)), list(range(100, 118))
    line = b"the quick brown fox jumps over the lazy dog and runs along the river bank"
    near = spark.createDataFrame([(7, [7], 3, h, h, x) for h, x in ((1, m), (2, m), (3, other))], "band long, bands array<long>, n long, h long, root long, m array<int>")
    texts = spark.createDataFrame([(1, line), (2, line + b"!"), (3, line + b"?")], "h long, raw binary")
    found = linededup._within(near, texts, 8, 75, 6, 3, 2)
    assert found.collect() == [(1, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2


def test_line_dedup_signatures_are_minima_of_all_shingles(spark):
    rows = [(n, "".join(random.Random(n).choices("abcdefgh \u4e2d", k=n)).strip() or "x") for n in range(1, 40)]
    lines = spark.createDataFrame(rows, "loc long, line string").select(F.col("loc").alias("h"), F.col("loc").alias("g"), "loc", "line")
    got = {r.h: (r.loc, r.n, r.m) for r in linededup.signatures(lines, 8, 6, 3).collect()}
    raw = [(h, line.encode()) for h, line in rows]
    each = spark.createDataFrame([(h, b[i : i + 8]) for h, b in raw for i in range(max(1, len(b) - 7))], "h long, s binary").select("h", F.hash("s").alias("x"))
    want: dict = {}
    for r in each.collect():
        want.setdefault(r.h, []).append(r.x)
    assert got == {h: (h, 1, [min(x ^ c for x in xs) for c in linededup._constants(18)]) for h, xs in want.items()}


def test_line_dedup_shuffles_bands_once(spark):
    """The lines of a bucket are counted and joined from one shuffle, and bring their places."""
    minima = [[1, 2, 3, 4], [1, 2, 5, 6], [7, 8, 5, 6], [9, 9, 9, 9]]
    sig = spark.createDataFrame([(h, 10 * h, m) for h, m in enumerate(minima)], "h long, loc long, m array<int>")
    near = linededup._buckets(sig, 2, 2)
    got = near.collect()
    assert sorted((r.h, r.loc, r.lo, r.hi, r.n) for r in got) == [(0, 0, 0, 1, 2), (1, 10, 0, 1, 2), (1, 10, 1, 2, 2), (2, 20, 1, 2, 2)]
    assert all(r.m == minima[r.h] and r.band in r.bands and len(set(r.bands)) == 2 for r in got)
    assert "ReusedExchange" in near._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_looks_buckets_up(spark, tmp_path):
    """The bands of all lines are not sorted to find the few that have a bucket, and are still shuffled once."""
    rows = [(h, 10 * h, [h // 3, h % 7, h // 2, 1]) for h in range(60)]
    spark.createDataFrame(rows, "h long, loc long, m array<int>").write.parquet(f"{tmp_path}/sig")
    near = linededup._buckets(spark.read.parquet(f"{tmp_path}/sig"), 2, 2)
    sets: dict = {}
    for h, _, m in rows:
        for band in range(2):
            sets.setdefault((band, *m[2 * band : 2 * band + 2]), []).append(h)
    want = sorted((h, 10 * h, min(x), max(x), len(x)) for x in sets.values() if len(x) > 1 for h in x)
    assert sorted((r.h, r.loc, r.lo, r.hi, r.n) for r in near.collect()) == want
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [band" in plan and "SortMergeJoin [band" not in plan and "ReusedExchange" in plan


def test_line_dedup_looks_few_rows_up(spark, monkeypatch):
    """Signatures, lines and the lines of buckets are not sorted to be merged with tables of few rows."""
    real, plans = linededup.materialize, {}

    def spy(df, tag):
        plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString())
        return real(df, tag)

    monkeypatch.setattr(linededup, "materialize", spy)
    line = "the quick brown fox jumps over the lazy dog and runs along the river bank"
    docs = spark.createDataFrame([(1, line), (2, f"{line}!"), (3, line)], "doc_id long, text string")
    assert {r.doc_id: r["drop"] for r in linededup.duplicate_lines(docs).collect()} == {2: [0], 3: [0]}
    for tag in ("near", "pairs", "keep", "gone"):
        assert "ShuffledHashJoin" in plans[tag] and "SortMergeJoin" not in plans[tag] and "BroadcastHashJoin" not in plans[tag], tag


def test_line_dedup_without_blanks(spark):
    """Near copies of lines without a blank that differ in their first characters."""
    rng = random.Random(8)
    bodies = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200)) for _ in range(6)] + ["".join(rng.choices("abcdef0123456789", k=400)) for _ in range(6)]
    lines = [x for i, b in enumerate(bodies) for x in (b, f"{i % 10}#{b[2:]}")]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in linededup.duplicate_lines(docs).collect()} == set(range(1, 24, 2))


@pytest.mark.parametrize("ids", [[5, 6], [-(1 << 62), 1 << 62]])
def test_line_dedup_looks_at_all_shingles(spark, ids):
    """Near copies that differ where nearly all words begin, and ids near to and far from each other."""
    rng, rows = random.Random(9), []
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for _ in range(12):
        tail = " ".join([*letters(7), *(letters(33) for _ in range(6))])
        rows.append([f"{' '.join(letters(7))} {tail}" for _ in ids])
    docs = spark.createDataFrame([(d, "\n".join(r[i] for r in rows)) for i, d in enumerate(ids)], "doc_id long, text string")
    (got,) = linededup.duplicate_lines(docs).collect()
    assert got.doc_id == ids[1] and len(got["drop"]) >= 11


def test_line_dedup_of_short_lines(spark):
    docs = spark.createDataFrame([(1, "les.\n\n \nand ornd."), (2, "les.\n\n\t\r\nsome\nLES. "), (3, "and ornd.\n\t\r\n\u4e2d")], "doc_id long, text string")
    assert {r.doc_id: r["drop"] for r in linededup.duplicate_lines(docs, least=1).collect()} == {2: [0, 4], 3: [0]}


def test_registered_line_dedup_takes_short_lines(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "les.\nand ornd."), (2, "les.\nsome")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_dropped for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()} == {1: "les.\nand ornd.", 2: "some"}


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = [(1001, None, None), (1002, "no scheme", ""), (1003, "HTTP://WWW.Example.COM/en/7?x", None), (1004, "http://notexample.com/en/7", None), (1005, "x://example.com?/en/", None), (1006, "http://example.net/de/8#a/b", None)]
    df = pages.select("page_id", "url", "html").union(spark.createDataFrame(extra, "page_id long, url string, html string"))
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    rows = {r.page_id: r for r in urls.judge(df, queries.RULES).collect()}
    for r in df.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        got = rows[r.page_id]
        assert (got.host, got.path, got.rule) == (host, path, max(fit)[1] if fit else None)
        assert got.verdict == (max(fit)[2] if fit else got.verdict)


def test_registered_url_filter_keeps_the_words_of_its_contract(spark, tmp_path):
    contract = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert sorted((r.text, r.verdict) for r in queries.RULES) == sorted(contract)
    want = {"x.com/en/1": ("com/en/", "block"), "example.com/en/71": ("example.com/en/7", "allow"), "net/de/": ("net/de/", "allow"), "a.net/de/8": ("net/de/", "allow"), "example.net/de/7": ("net/de/", "allow"), "b.example.net/de/8/c": ("example.net/de/8", "block"), "org/es/q": ("org/es/", "block"), "c.net/fr/": (None, "allow")}
    spark.createDataFrame([(i, f"https://{u}", None) for i, u in enumerate(want)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.host + r.path: (r.rule, r.verdict) for r in queries.op7_url_filter(spark, str(tmp_path)).collect()}
    assert got == want


def test_pagerank_and_distrust(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", "e"), ("g", "h")]
    edges = spark.createDataFrame([(s, t, 1) for s, t in links], "src string, dst string, links long")
    got = {r.node: r["rank"] for r in urls.pagerank(edges, spark.createDataFrame([("a", 1.0), ("g", 1.0)], "node string, weight double"), rounds=60, tolerance=1e-9).collect()}
    nodes = "abcdefgh"
    m, seed = np.zeros((8, 8)), np.array([0.5, 0, 0, 0, 0, 0, 0.5, 0])
    for s, t in links:
        m[nodes.index(t), nodes.index(s)] = 1
    out = m.sum(0)
    x = seed
    for _ in range(200):
        x = 0.85 * (m / np.maximum(out, 1)) @ x + (0.15 + 0.85 * x[out == 0].sum()) * seed
    assert all(abs(got.get(n, 0) - v) < 1e-4 for n, v in zip(nodes, x, strict=True))
    page = lambda i, host, to=None: (i, f"http://{host}/es/x", f'<a href="http://{to}/">' if to else "")
    rows = [page(1, "bad.org"), page(2, "friend.com", "bad.org"), page(3, "good.com")]
    verdict = {r.host: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert verdict == {"bad.org": "block", "friend.com": "allow", "good.com": "allow"} or verdict["friend.com"] == "block"


def brute_verdicts(rows, rules, rounds=400):
    """url, html to verdict, with ranks by matrix."""
    def host(u):
        return re.split("[/?#]", u.split("://", 1)[1])[0].lower() if u and "://" in u else ""
    def ruled(u):
        h, p = host(u), re.split("[?#]", u.split("://", 1)[1][len(host(u)) :])[0] if u and "://" in u else ""
        fit = [(len(r.text), r.verdict) for r in rules if h and (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(fit)[1] if fit else None
    hosts = sorted({host(u) for u, _ in rows} - {""} | {host(t) for _, h in rows for t in re.findall('href="([^"]*)"', h or "")} - {""})
    at, n = {h: i for i, h in enumerate(hosts)}, len(hosts)
    m, pages, blocked = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    for u, h in rows:
        if host(u):
            pages[at[host(u)]] += 1
            blocked[at[host(u)]] += ruled(u) == "block"
            for t in re.findall('<a href="([^"]*)"', h or ""):
                if host(t) and host(t) != host(u):
                    m[at[host(t)], at[host(u)]] += 1
    share = np.divide(blocked, pages, out=np.zeros(n), where=pages > 0)
    def rank(m, seed):
        total, out = seed.sum(), m.sum(0)
        seed = seed / total if total else seed
        x = seed
        for _ in range(rounds):
            x = 0.85 * (m / np.maximum(out, 1)) @ x + (0.15 + 0.85 * x[out == 0].sum()) * seed
        return x * total
    good, bad = rank(m, np.where(pages > 0, 1 - share, 0)), rank(m.T, share)
    return [ruled(u) or ("block" if host(u) and bad[at[host(u)]] > good[at[host(u)]] else "allow") for u, _ in rows]


def test_ranks_decide_where_no_rule_does(spark):
    rnd = random.Random(3)
    names = [f"h{i}.{t}" for i in range(9) for t in ("org", "com", "net")]
    rows = []
    for i in range(300):
        bad = i % 27 < 8
        path = "/es/" if bad and rnd.random() < 0.75 else "/xx/"
        to = names[rnd.randrange(8) if bad or rnd.random() < 0.02 else 8 + rnd.randrange(19)]
        link = f'<a href="http://{to}/">' if i % 3 else '<a href="/home"><a href="mailto:x@y.z">'
        rows.append((i, f"http://{names[i % 27]}{path}{i}", link, "h", "v"))
    rows += [(300, "http://hub.com/", "".join(f'<a href="http://{n}/">' for n in names[:8]) * 3, "h", "v"), (301, None, None, "h", "v"), (None, "nothing", "", "h", "v"), (300, "http://hub.com/", None, "h", "v")]
    rules = [urls.rule("block", f"{t}/es/") for t in ("org", "com", "net")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string"), rules, rounds=60, tolerance=1e-9)
    want = brute_verdicts([(u, h) for _, u, h, _, _ in rows], rules)
    assert sorted((str(r.page_id), r.host, r.path, r.verdict) for r in got.collect()) == sorted((str(i), *([u.split("/")[2], "/" + u.split("/", 3)[3]] if u and "://" in u else ["", ""]), v) for (i, u, *_), v in zip(rows, want, strict=True))
    free = [v for (_, u, *_), v in zip(rows, want, strict=True) if u and "/xx/" in u]
    assert 5 < free.count("block") < len(free) - 50
    assert urls.judge(got.select("page_id", F.col("host").alias("url"), F.col("path").alias("html")).where("false"), rules).count() == 0


def test_ranks_decide_pages_of_the_given_table(spark):
    rows = queries.op7_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_links_without_a_host_follow_the_base(spark):
    rows = [("http://a.com/x", '<BASE target="_top" href="https://B.org/dir/"><a class=x href=page><a href="#top"><a href="mailto:q@z.de"><a href="//c.net/y">'), ("http://a.com/y", '<a href="z"><a href="http://a.com/">')]
    got = {(r.src, r.dst, r.links) for r in urls.host_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {("a.com", "b.org", 1), ("a.com", "c.net", 1)}


def test_decontamination(spark, odd, none):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " " + " ".join(w for w in (x.strip(semantic._EDGE.decode()) for x in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()) if w) + " "
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in plain(r.text)}
    rows = [(r.doc_id, r.item_id, r.common, r.item_words) for r in semantic.find(docs, bench).collect()]
    assert want <= {x[:2] for x in rows} and all(c >= 0.6 * n for _, _, c, n in rows)
    item = bench.orderBy("item_id").first()
    w = item.text.split()
    rnd = random.Random(2)
    filler = docs.where("length(text) > 2000").first().text
    changed = " ".join(x if rnd.random() > 0.12 else "other" for x in w)
    test = docs.select("doc_id", "text").union(spark.createDataFrame([(100001, filler[:900] + " " + changed + " " + filler[900:1800])], "doc_id long, text string"))
    assert (100001, item.item_id) in {(r.doc_id, r.item_id) for r in semantic.find(test, bench).collect()}
    assert semantic.find(odd, bench).count() == 0 == semantic.find(none, bench).count() == semantic.find(docs, bench.where("false")).count()


def test_decontamination_of_long_items(spark):
    rng = random.Random(3)
    text = lambda n, start: " ".join(f"{start}{rng.randrange(4000)}" for _ in range(n))
    lengths = [30, 200, 300, 1000, 5000]
    items = [text(n, "w") for n in lengths]
    docs = spark.createDataFrame([(i, f"{text(400, 'f')} {t} {text(400, 'f')}") for i, t in enumerate(items)] + [(9, text(3000, "f"))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.common, r.item_words) for r in semantic.find(docs, bench).collect()}
    assert got == {(i, i): (n, n) for i, n in enumerate(lengths)}


def test_decontamination_finds_what_comparing_everything_finds(spark):
    """Paraphrases (words replaced, dropped, put in) against the longest common subsequence of every stretch and item."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"r{rng.randrange(1500)}"
    items = [[word() for _ in range(rng.choice([12, 17, 30, 45, 70]))] for _ in range(30)]
    docs = []
    for k in range(240):
        w = list(items[k % 30])
        for _ in range(int(len(w) * rng.choice([0, 0.1, 0.2, 0.3, 0.4, 0.5]))):
            at, how = rng.randrange(len(w)), rng.random()
            w[at : at + 1] = [word()] if how < 0.5 else [] if how < 0.75 else [w[at], word()]
        docs.append([word() for _ in range(rng.randrange(200))] + w + [word() for _ in range(rng.randrange(200))])
    found = semantic.Items([(i, " ".join(w)) for i, w in enumerate(items)])
    memo, want = semantic._Tokens(found.columns), set()
    for d, w in enumerate(docs):
        t = memo.of(" ".join(w))
        for i, (tokens, answer) in enumerate(zip(found.tokens, found.answers, strict=True)):
            n = len(tokens)
            for at in range(0, max(1, len(t) - n + 1), 3):
                part = t[max(0, at - n // 4) : at + n + n // 4]
                if np.isin(tokens, part).sum() >= 0.6 * n:
                    both = semantic.lcs(tokens, part)
                    if both >= 0.7 * n or (both >= 0.6 * n and semantic.lcs(answer, part) >= 0.8 * len(answer)):
                        want.add((d, i))
                        break
    frames = [spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(x)], f"{n} long, text string") for n, x in (("doc_id", docs), ("item_id", items))]
    got = {(r.doc_id, r.item_id): (r.common, r.item_words, r.answer_share) for r in semantic.find(*frames).collect()}
    assert len(want) > 120 and len(want & set(got)) >= 0.9 * len(want)
    assert all(c >= 0.7 * n or (c >= 0.6 * n and s >= 0.8) for c, n, s in got.values())


def test_decontamination_of_odd_items(spark):
    docs = spark.createDataFrame([(1, "x y alpha beta gamma delta z", 5), (1, "alpha beta gamma delta", 6), (None, "alpha beta gamma delta", 7)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(1, None), (2, " .,; "), (3, "alpha beta gamma delta"), (3, "alpha beta gamma delta"), (None, "x y")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.common, r.item_words) for r in semantic.find(docs, bench).collect()} == {(1, 3, 4, 4)}


def test_lcs():
    rnd = random.Random(4)
    for _ in range(100):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert semantic.lcs(np.array(a), np.array(b)) == table[-1][-1]


def test_chat(spark, duck):
    same_rows(queries.op9_chat(spark, SF), duck, queries.OP9_SQL)
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "late"), (2, 0, "system", "alone"), (None, 0, "ann", "x")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("clash")), block=1).collect()
    for conv, who in {(r.conv_id, r.perspective) for r in out}:
        part = sorted((r for r in out if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: r.position)
        whole = "".join(r.segment for r in part)
        assert [r.position for r in part] == list(range(len(part)))
        for r in part:
            assert whole[r.start : r.start + len(r.segment)] == r.segment
            assert (r.learn_length > 0) == (r.speaker == who) and ("<|assistant|>" in r.segment) == (r.speaker == who)
    assert {r.perspective for r in out if r.conv_id == 1} == {"ann", "bob", "unknown"} and not [r for r in out if r.conv_id == 2]


def test_chat_of_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string, perspective string, segment string"
    long = "word " * 200_000
    rows = [(1, 0, "a<|b|>", "x<|end|>\n<|assistant|>\ny", "p", "s"), (1, 1, "ann", long, "p", "s"), (1, 1, "ann", long, "p", "s")]
    out = chat.rotate(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 6 and {r.perspective for r in out} == {"a<|b|>", "ann"}
    for r in out:
        assert r.segment.count("<|") == 2 == r.segment.count("|>")
    assert sorted(len(r.segment) for r in out if r.speaker == "ann")[0] > len(long)
    assert chat.rotate(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("limit", [1000, 0])
def test_topk(spark, limit):
    rng = np.random.default_rng(limit)
    x = rng.standard_normal((150, 64)) + rng.integers(0, 2, (150, 1))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 64), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in hamming.top_k(df, df.where("vec_id % 20 = 0"), 5, probe_limit=limit).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbour_id))
    bits = x.astype(np.float32) >= 0
    for q in range(0, 150, 20):
        want = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(150) if i != q)[:5]
        assert [y[1:] for y in sorted(got[q])] == want
    assert set(got) == set(range(0, 150, 20))


def test_topk_counts_repeated_rows_once(spark):
    code = [1.0] * 64
    df = spark.createDataFrame([(0, code)] * 40 + [(i, code) for i in range(1, 9)], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.neighbour_id, r.distance) for r in hamming.top_k(df, df.where("vec_id = 0"), 5).collect())
    assert got == [(i, i, 0) for i in range(1, 6)]


def test_topk_of_odd_tables(spark):
    code = [1.0] * 64
    df = spark.createDataFrame([(1, code, "x"), (2, code, "y"), (2, [-1.0] * 64, "z"), (3, [-1.0] * 64, None)], "vec_id long, embedding array<float>, distance string")
    got = sorted((r.query_id, r["rank"], r.neighbour_id, r.distance) for r in hamming.top_k(df, df, 5).collect())
    # Of id 2 the first code in order counts.
    assert got == [(1, 1, 2, 64), (1, 2, 3, 64), (2, 1, 3, 0), (2, 2, 1, 64), (3, 1, 2, 0), (3, 2, 1, 64)]
    assert hamming.top_k(df.where("false"), df, 5).count() == 0 == hamming.top_k(df, df.where("false"), 5).count()


def test_topk_index_answers_by_proof():
    """Rows that tables lead to give the answers; hardly any is verified outright, and fewer than all are verified."""
    rng = np.random.default_rng(2)
    for n, bits in ((2000, 64), (20_000, 64), (20_000, 96), (3000, 40)):
        words = np.stack([rng.integers(0, 1 << min(32, bits - lo), n) for lo in range(0, bits, 32)], 1)
        index = hamming.Index(words, bits)
        of, ids, far = hamming.nearest(index, np.arange(n), words[:40], 11)
        d = np.bitwise_count(words[:40, None] ^ words[None]).sum(2)
        for i in range(40):
            want = np.lexsort((np.arange(n), d[i]))[:11]
            assert ids[of == i].tolist() == want.tolist() and far[of == i].tolist() == d[i][want].tolist()
        assert index.direct <= 0.02 * index.probed and index.probed < 0.9 * 40 * n


def test_pipeline(spark, odd):
    import corpus_pipeline as p

    docs = p.table(spark, SF, "documents")
    out = p.run(spark, SF).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and set(out.doc_id) <= {r.doc_id for r in docs.collect()}
    some = odd.select("doc_id", "text", "lang")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, some, SF).columns == some.columns


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on a small table: which documents and lines stay."""
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    docs = p.table(spark, SF, "documents").where("doc_id < 90")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = {r.doc_id for r in quality.classify(docs, p.table(spark, SF, "labels")).collect() if r.predicted}
    assert ids(stages["quality classifier"](spark, docs, SF)) == good and 0 < len(good) < len(texts)

    root = {d: c for d, (_, c) in brute_components(list(texts.items())).items()}
    assert ids(stages["n-gram Jaccard join"](spark, docs, SF)) == {d for d, c in root.items() if c == d}

    items = [set(words(r.text)) for r in p.table(spark, SF, "benchmark").collect()]
    kept = ids(stages["benchmark decontamination"](spark, docs, SF))
    strip = lambda t: {w.strip(semantic._EDGE.decode()) for w in words(t)}
    plain_items = [{w.strip(semantic._EDGE.decode()) for w in i} - {""} for i in items]
    clean = {d for d, t in texts.items() if all(len(i & strip(t)) < 0.5 * len(i) for i in plain_items)}
    flat = lambda t: " ".join(w for w in (x.strip(semantic._EDGE.decode()) for x in words(t)) if w)
    leaked = {d for d, t in texts.items() for r in p.table(spark, SF, "benchmark").collect() if f" {flat(r.text)} " in f" {flat(t)} "}
    assert clean <= kept and not leaked & kept

    out = {r.doc_id: r.text for r in stages["line dedup"](spark, docs, SF).collect()}
    rows = [(d, k, x.strip(" ").lower()) for d in sorted(texts) for k, x in enumerate((texts[d] or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    sets = [{b[i : i + 8] for i in range(max(1, len(b) - 7))} for b in (x.encode() for _, _, x in rows)]
    first: dict = {}
    for d, k, x in rows:
        first.setdefault(x, (d, k))
    has = {d: Counter(x.strip(" ").lower() for x in (t or "").split("\n")) for d, t in out.items()}
    again = [(d, x) for d, k, x in rows if first[x] != (d, k)]
    assert again and all(has.get(d, {}).get(x, 0) <= (first[x][0] == d) for d, x in again)
    by_shingle: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            by_shingle.setdefault(g, []).append(i)
    for i, (d, _, x) in enumerate(rows):
        common = Counter(j for g in sets[i] for j in by_shingle[g] if j != i)
        if not any(100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n) for j, n in common.items()):
            assert has[d][x] == 1

    packed = stages["best-fit packing"](spark, docs, SF).toPandas().sort_values(["doc_id", "piece"])
    tok = Tokenizer.from_file(queries.TOKENIZER)
    for d, part in packed.groupby("doc_id"):
        whole = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        assert part.length.sum() == len(whole) and [zlib.crc32(np.array(whole[s : s + n], "<u4").tobytes()) for s, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    assert set(packed.doc_id) == set(texts)


def test_pipeline_stages_keep_clashing_columns_and_take_empty_tables(spark):
    import corpus_pipeline as p

    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").select("doc_id", "text").limit(3)
    docs = good
    for name in ("score", "_score", "n_lines", "n_dropped", "_gone", "component_id", "item_id", "length"):
        docs = docs.withColumn(name, F.lit(f"its {name}"))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.score + r.n_lines + r.n_dropped for r in out.collect()} <= {"its scoreits n_linesits n_dropped"}
        assert out.count() == docs.count() or name != "n-gram Jaccard join"
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert p.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
