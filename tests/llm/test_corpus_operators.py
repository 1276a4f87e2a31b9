"""Operators over whole tables: line dedup, near duplicates, mixing, packing, WARC and the pipeline."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from conspectus.llm import line_dedup, minhash, mixing, packing, queries, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' as n_lines", "'y' as `__node`", "1 as node", "2 as hash")


def line(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def brute_lines(rows, least):
    """Kept text of each (id, text): lines of runs of at least ``least`` words that occur earlier go."""
    docs = sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0))
    first, cut = {}, defaultdict(set)
    for number, (_, text) in enumerate(docs):
        lines = text.split("\n")
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b].encode().split())
                if words >= least:
                    key = tuple(lines[a : b + 1])
                    own = first.setdefault(key, (number, a))
                    if own[0] != number or a > own[1] + b - a:
                        cut[number] |= set(range(a, b + 1))
    return Counter((i, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in cut[n])) for n, (i, t) in enumerate(docs))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [line(rng, n) for n in (60, 3, 25, 30, 10, 0, 55, 8, 20, 20, 20)]
    rows = []
    for i in range(60):
        own = [line(rng, rng.randrange(0, 40)) for _ in range(rng.randrange(1, 6))]
        at = rng.randrange(len(pool) - 3)
        own[rng.randrange(len(own)) : 0] = pool[at : at + rng.randrange(1, 4)]
        rows.append((i, "\n".join(own)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (None, rows[5][1]), (103, "\n".join(["five words in a line"] * 30)), (104, "\n\n")]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in got if r.text is not None) == brute_lines(rows, 50)
    assert [r.doc_id for r in got if r.text is None] == [101]
    by = {r.doc_id: r for r in got}
    assert by[100].text == "" or by[100].text == by[3].text
    assert by[103].text == "\n".join(["five words in a line"] * 10)
    assert {"n_lines", "__node", "node", "hash"} <= set(got[0].asDict())
    assert line_dedup.dedup_lines(table(spark, rows).limit(0)).count() == 0


def test_passages_inside_lines_go(spark):
    rng = random.Random(8)
    own = [line(rng, 20) for _ in range(14)]
    passage, short, whole = line(rng, 54), line(rng, 49), line(rng, 60)
    half = passage.split()
    rows = [
        (1, f"{own[0]} {passage} {own[1]}"),
        (2, f"{own[2]} {passage} {own[3]}\n{own[4]}"),
        (3, f"{own[5]} {' '.join(half[:20])}\n\n{' '.join(half[20:])} {own[6]}"),
        (4, f"{own[7]}\n{passage}\n{own[8]} {short}"),
        (5, f"{own[9]} {short}\n{whole}"),
        (6, f"{own[10]}\n{whole}\n{own[11]} {passage}"),
        (7, f"{own[12]} {whole}"),
        (8, f"é {passage} {passage} {own[13]}"),
    ]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == {
        1: rows[0][1],
        2: f"{own[2]} {own[3]}\n{own[4]}",
        3: f"{own[5]}\n{own[6]}",
        4: f"{own[7]}\n{own[8]} {short}",
        5: rows[4][1],
        6: f"{own[10]}\n{own[11]}",
        7: own[12],
        8: f"é {own[13]}",
    }


def test_fingerprints_alone_feed_the_join(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, "\n".join(line(rng, 12) for _ in range(40))) for i in range(20)]
    rows.append((30, rows[4][1]))
    base = table(spark, rows).selectExpr("doc_id as __id", "xxhash64(text) as __node", "text as __text")
    marks = line_dedup.fingerprints(base)
    lines = marks.where("not words")
    per_text = lines.count() / len(rows)
    raw, bounds = tokens.string_bytes(pa.array([rows[0][1]]))
    assert per_text < len(line_dedup.line_windows(raw, bounds)["first"]) / 2  # windows are no rows here
    hits = line_dedup.repeated_marks(lines)
    assert {r["__id"] for r in hits.select("__id").distinct().collect()} == {4, 30}
    no_parts = line_dedup.part_requests(line_dedup.repeated_marks(marks.where("words")).limit(0))
    runs = line_dedup.later_windows(line_dedup.answers(base, line_dedup.line_requests(hits), no_parts)[0]).collect()
    assert {j for r in runs for j in range(r["first"], r["last"] + 1)} == set(range(40)) and {r["__id"] for r in runs} == {30}
    assert line_dedup.answers(base, line_dedup.line_requests(hits.limit(0)), no_parts)[0].count() == 0  # no fingerprints, no windows


def brute_words(rows, least):
    """Words of each (id, text) that lie in a stretch of ``least`` words that occurs earlier (ids rise, no overlap)."""
    first, out = {}, {}
    for i, text in rows:
        words = text.split()
        gone = set()
        for a in range(len(words) - least + 1):
            own = first.setdefault(tuple(words[a : a + least]), (i, a))
            if own[0] != i or a - own[1] >= least:
                gone |= set(range(a, a + least))
        out[i] = [w for j, w in enumerate(words) if j not in gone]
    return out


def test_word_passages_equal_brute_force(spark):
    rng = random.Random(21)
    pool = [line(rng, n) for n in (50, 51, 54, 80, 49, 200)]
    rows = []
    for i in range(40):
        own = [line(rng, rng.randrange(1, 40)) for _ in range(4)]
        own[rng.randrange(4)] += " " + pool[i % 6] + " " + line(rng, 5)
        rows.append((i, "\n".join(own)))
    rows.append((50, " ".join([pool[3], pool[3], pool[3], pool[2]])))
    got = {r.doc_id: r.text.split() for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == brute_words(rows, 50)


def test_passages_go_whatever_the_first_text_with_their_fingerprint(spark):
    rng = random.Random(77)
    rows = []
    for _ in range(12):
        p = line(rng, 60).split()
        # three earlier texts hold every fingerprint of the passage, but under 50 words of it; then two hold it whole
        rows += [" ".join([line(rng, 30), *part, line(rng, 30)]) for part in (p[:45], p[15:], p[8:53])]
        rows += [" ".join([line(rng, 20), *p, line(rng, 20)]), " ".join([line(rng, 20), *p[:55], line(rng, 20), *p[3:]])]
    # few words: runs occur often, in one text and in several, also overlapping
    pool = [" ".join(rng.choice("ab") for _ in range(rng.randrange(8, 40))) for _ in range(6)]
    rows += [" ".join(rng.choice(pool) for _ in range(rng.randrange(3, 30))) for _ in range(30)]
    rows += [" ".join(["x"] * n) for n in (49, 50, 99, 100, 101, 230)] + [" ".join(["x y z"] * n) for n in (16, 17, 40, 60)]
    rows = list(enumerate(rows))
    got = {r.doc_id: r.text.split() for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == brute_words(rows, 50)


def test_line_dedup_of_a_very_long_text(spark):
    rng = random.Random(31)
    text = "\n".join(line(rng, 15) for _ in range(12000))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, [(1, text), (2, "x\n" + text[700_000:900_000]), (3, "a " * 600_000)])).collect()}
    assert len(text) > 10**6 and got[1] == text and len(got[2]) < 300 and got[3].split() == ["a"] * 50


def test_repeated_rows_of_one_document_keep_the_same_lines(spark):
    text = "\n".join(" ".join(f"a{i}.{j}" for j in range(30)) for i in range(4))
    got = line_dedup.dedup_lines(table(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, text), (1, text), (2, "")]


def exact_classes(rows):
    sets = {}
    for n, (_, text) in enumerate(rows):
        w = WORD.findall(text or "")
        k = min(5, len(w))
        sets[n] = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else Counter()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            both = sum((x & y).values())
            total = sum((x | y).values())
            if (both / total if total else 1.0) >= 0.8 or (rows[a][1] or "") == (rows[b][1] or ""):
                root[find(a)] = find(b)
    out = defaultdict(set)
    for n in range(len(rows)):
        out[find(n)].add(rows[n][0])
    return {frozenset(v) for v in out.values()}


def near_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        words = line(rng, rng.randrange(40, 300)).split()
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, ""), (904, "one two"), (905, "one two"), (906, "one two three")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = minhash.near_duplicates(table(spark, rows).repartition(5)).collect()
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    assert {frozenset(v) for v in classes.values()} == exact_classes(rows)
    assert all(k == min(v) for k, v in classes.items())
    assert {r.doc_id for r in got if r.kept} == set(classes)
    assert minhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(9)
    words = line(rng, 120).split()
    rows = [(0, " ".join(words))]
    for i in range(1, 400):
        copy = list(words)
        copy[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_a_crowded_run_compares_all_that_is_apart(spark):
    rng = random.Random(7)
    words = line(rng, 120).split()

    def changed(text, n):
        copy = list(text)
        for j in rng.sample(range(len(copy)), n):
            copy[j] = f"z{rng.randrange(10**9)}"
        return copy

    mates = [(m, changed(m, 2)) for m in (changed(words, 4) for _ in range(300))]
    rows = [(i, " ".join(text)) for i, text in enumerate(x for pair in mates for x in pair)]
    keys = {r.doc_id: r.bands[0] for r in minhash.signatures(table(spark, rows), "text", ("doc_id",), 16, 4).collect()}
    common = Counter(keys.values()).most_common(1)[0][0]
    rows = [r for r in rows if keys[r[0]] == common]  # all under one key
    expected = exact_classes(rows)
    assert len(rows) > 60 and len(expected) > 20
    classes = defaultdict(set)
    for r in minhash.near_duplicates(table(spark, rows), k=16, rows=4).collect():
        classes[r.class_id].add(r.doc_id)
    assert {frozenset(v) for v in classes.values()} == expected


def test_classes_do_not_depend_on_partitions(spark):
    rng = random.Random(11)
    words = line(rng, 150).split()
    rows = []
    for i in range(300):
        copy = list(words)
        for j in rng.sample(range(150), rng.randrange(1, 12)):
            copy[j] = f"q{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    expected = exact_classes(rows)
    assert 1 < len(expected) < 290
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (4, 51, 211):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            classes = defaultdict(set)
            for r in minhash.near_duplicates(table(spark, rows).repartition(3)).collect():
                classes[r.class_id].add(r.doc_id)
            assert {frozenset(v) for v in classes.values()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_of_each_keeps_whole_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, None), (7, None)]
    got = minhash.one_of_each(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(2, "a b c d e f"), (7, None)]
    assert set(got[0].asDict()) == {"doc_id", "text", "n_lines", "__node", "node", "hash"}


def test_dart_signature_agrees_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    a, b = rng.integers(1, 4, len(values)).astype(float), rng.integers(0, 3, len(values)) + 0.5
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    k = 4000
    x, y = minhash.dart_minhash(values, a, k), minhash.dart_minhash(values, b, k)
    assert abs(float((x == y).mean()) - truth) < 4 * np.sqrt(truth * (1 - truth) / k)
    assert (minhash.dart_minhash(values[:1], np.ones(1), 80) == minhash.dart_minhash(values[:1], np.ones(1), 80)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160)) and got[201] == 200
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


MIX = [(i, f"s{i % 4}" if i % 5 else None, "w " * (i % 17 * (20 if i % 4 == 1 else 1))) for i in range(300)] + [(3, "s3", "w w"), (3, "s3", "w w"), (301, "s1", None), (302, "lone", "w " * 5), (None, "s2", "w")]


def compare(spark, tmp_path, name, rows, fn, sql):
    path = str(tmp_path / name)
    rows.write.parquet(path + ".parquet")
    got = fn(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}.parquet/*.parquet'")
    cursor = con.sql(sql)
    names = sorted(cursor.columns)
    assert sorted(got.columns) == names
    expected = Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in (dict(zip(cursor.columns, r, strict=True))[c] for c in names)) for r in cursor.fetchall())
    assert Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in names)) for r in got.collect()) == expected
    return got


def test_mixing_equals_sql(spark, tmp_path):
    rows = spark.createDataFrame(MIX, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as `rank`", "3 as key")
    got = compare(spark, tmp_path, "documents", rows, mixing.op4_mixing, mixing.OP4_SQL).collect()
    assert sum(r.taken for r in got) <= sum(r.size for r in got)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.target <= 3 * r.source_size + 1e-9 for r in got)
    assert mixing.mixed(rows.limit(0)).count() == 0
    small = mixing.mixed(rows, cell_rows=7).select("doc_id", "size", "taken")
    assert sorted(map(str, small.collect())) == sorted(map(str, mixing.mixed(rows).select("doc_id", "size", "taken").collect()))
    assert mixing.mixed(rows.selectExpr("doc_id", "source", "'' as text")).where("taken > 0").count() == 0


def test_targets_share_the_excess(spark):
    rows = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 100, 1), (None, 500, 1)], "source string, source_size long, rows long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    target, open_, weight = {"a": 30.0}, 1610.0, {"b": 2, "c": 3, None: 1}
    target["c"] = 300.0  # its share of the rest is over three times its size
    target |= {s: (open_ - 330) * weight[s] / 3 for s in ("b", None)}
    assert got == pytest.approx(target)


def test_packing_places_every_token_once(spark):
    rows = [(i, "w " * (i * 37 % 900)) for i in range(300)] + [(1000, "w " * 20000), (1001, None), (1002, ""), (5, "w " * 10), (5, "w " * 10), (None, "w w")]
    got = packing.pack_documents(table(spark, rows), shard_rows=100).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    expected = Counter()
    for i, t in rows:
        expected[i] += len(WORD.findall(t or ""))
    assert +tokens == +expected
    bins = defaultdict(list)
    for r in got:
        if r.n_tokens:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None and r.capacity is None
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        end = 0
        for r in members:
            assert r.offset == end
            end += r.n_tokens
        assert members[0].capacity == min(c for c in packing.LENGTHS if c >= end)
    assert sum(len(WORD.findall(t or "")) for _, t in rows) / sum(m[0].capacity for m in bins.values()) > 0.95
    assert packing.pack_documents(table(spark, rows).limit(0)).count() == 0


def test_packing_keeps_ids_and_spreads_equal_ones(spark):
    big = 2**53
    rows = [(big + 1, "a b"), (big + 3, "c"), (None, "d e f")] + [(7, "w w")] * 3000 + [(None, "v")] * 2000
    got = packing.pack_documents(table(spark, rows), shard_rows=500).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert {(r.doc_id, r.n_tokens) for r in got if r.doc_id and r.doc_id > 7} == {(big + 1, 2), (big + 3, 1)}
    shards = Counter(r.bin_id.split("-")[0] for r in got)
    assert len(shards) == 11 and max(shards.values()) < 700


def plain_best_fit(sizes, lengths, price):
    bins, left = [], sum(sizes)  # [capacity, contents]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = [(c - sum(sizes[j] for j in held), b) for b, (c, held) in enumerate(bins) if c - sum(sizes[j] for j in held) >= sizes[i]]
        if room:
            b = min(room)[1]
        else:
            best = min((price(c) / min(c, left), -c) for c in lengths if c >= sizes[i])
            b = len(bins)
            bins.append((-best[1], []))
        bins[b][1].append(i)
        left -= sizes[i]
    return [(min(c for c in lengths if c >= sum(sizes[j] for j in held)), held) for _, held in bins]


@pytest.mark.parametrize("seed", range(20))
def test_pack_equals_brute_force(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(8, 200), 4))
    sizes = [rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(1, 120))]
    bins, offsets, capacity = packing.pack(sizes, lengths, packing.cost)
    expected = plain_best_fit(sizes, lengths, packing.cost)
    assert capacity == [c for c, _ in expected]
    for b, (_, held) in enumerate(expected):
        assert [i for i in held if bins[i] != b] == [] and [offsets[i] for i in held] == [sum(sizes[j] for j in held[:n]) for n in range(len(held))]


def test_pack_is_best_fit_with_priced_lengths():
    bins, offsets, capacity = packing.pack([6, 5, 4, 3, 2], lengths=(4, 8, 16), price=lambda c: c)
    assert sorted(Counter(bins).values()) and sum(capacity) <= 24
    flat = packing.pack([3, 3, 2, 2], lengths=(4, 10), price=lambda c: c + 1)
    assert flat[2] == [10]
    steep = packing.pack([4, 4], lengths=(4, 8), price=lambda c: c * c)
    assert steep[2] == [4, 4]


PAGES = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u4", ""), (5, "ü", "é😀"), (9, "u9", "<p>a</p>"), (7, "u7", "x" * 50000), (None, "n", "<p>a</p>"), (9, "u9", "<p>a</p>")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'z' as payload")


def test_warc_equals_sql(spark, tmp_path):
    got = compare(spark, tmp_path, "pages", pages(spark), warc.op5_warc, warc.OP5_SQL)
    for r in got.collect():
        data = next((h or "").encode() for i, _, h in PAGES if i == r.page_id)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.payload_bytes == len(data)


def test_warc_round_trip(spark):
    archive = warc.write_archive(pages(spark))
    assert archive.payloads.count() == len({h or "" for _, _, h in PAGES})
    records = warc.read_archive(archive).withColumn("bytes", warc.record_bytes()).collect()
    assert Counter((r.record_id, bytes(r.payload).decode()) for r in records) == Counter((i, h or "") for i, _, h in PAGES)
    for r in records:
        head, body = bytes(r.bytes).split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and int(fields[b"Content-Length"]) == len(body) - 4 and body.endswith(b"\r\n\r\n")
        assert fields[b"WARC-Type"].decode() == r.record_type and (b"WARC-Refers-To" in fields) == (r.record_type == "revisit")
        assert b"WARC-Date" in fields and (b"WARC-Profile" in fields) == (r.record_type == "revisit")
    ids = [dict(x.split(b": ", 1) for x in bytes(r.header).split(b"\r\n\r\n")[0].split(b"\r\n")[1:])[b"WARC-Record-ID"] for r in records]
    assert len(set(ids)) == len(PAGES)
    assert warc.read_archive(warc.write_archive(pages(spark).limit(0))).count() == 0
    kinds = {r.record_type for r in warc.read_archive(warc.write_archive(pages(spark), least=10**6)).collect()}
    assert kinds == {"response"}


def test_warc_headers_stay_whole(spark):
    rows = spark.createDataFrame([("a:1\r\nX: y>", "http://h/a b\r\nWARC-Type: evil\tz", "p"), ("ü", "", "q"), ("none", None, "q")], "page_id string, url string, html string")
    got = {r.record_id: r for r in warc.read_archive(warc.write_archive(rows, date="2020-01-02T03:04:05Z")).collect()}
    assert set(got) == {"a:1\r\nX: y>", "ü", "none"}
    assert got["a:1\r\nX: y>"].target_uri == "http://h/a%20b%0D%0AWARC-Type:%20evil%09z" and got["none"].target_uri == "about:blank"
    assert (got["none"].record_type, got["none"].refers_to) == ("revisit", "ü") and got["ü"].record_type == "response"
    assert all(b"WARC-Date: 2020-01-02T03:04:05Z\r\n" in bytes(r.header) for r in got.values())


def test_warc_notices_damage(spark):
    archive = warc.write_archive(pages(spark))
    damaged = warc.Archive(archive.headers, archive.payloads.selectExpr("digest", "cast(concat(cast(payload as string), '!') as binary) as payload", "n_bytes", "sha1"), "bigint")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(damaged).select("record_id", "n_bytes").collect()


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"s{i % 3}", " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(200)]
    rows += [(300 + i, "s1", "!! ".join(f"w{rng.randrange(400)}" for _ in range(60)).upper()) for i in range(60)]
    rows += [(500, "s1", rows[0][2]), (501, None, None), (None, "s2", "x y"), (502, "s1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars", "1 as `__size`")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300)) for i, _, _ in rows if i is not None and i < 360], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, now.limit(0), str(tmp_path)).count() == 0, name
        now = corpus_pipeline.written(out, f"test-{name}")
        if name != "mixing":
            assert now.where("doc_id < 200").count() > 197, name  # clean documents stay
    kept = {r.doc_id for r in now.where("text <> ''").select("doc_id").collect()}  # a copy's lines go, so it is empty
    assert not kept & set(range(300, 360)) and 500 not in kept
    placed = corpus_pipeline.run(spark, str(tmp_path))
    words = sum(len(WORD.findall(r.text or "")) for r in now.collect())
    assert placed.groupBy().sum("n_tokens").first()[0] == words


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
