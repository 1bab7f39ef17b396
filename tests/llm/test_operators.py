import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.llm import ann, importance, langid, media, mixing, packing, simhash, warc
from tessera.llm.common import FOLDERS, ShardReader, work_dir

from . import cases

# Media ------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    docs = cases.with_clashes(cases.documents(spark))
    root = work_dir(spark, "t-media")
    index = media.write_media(docs, root)
    rows = media.with_features(media.with_metadata(media.spread(index, "shard", "media_offset", "media_bytes"), root), root).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == len(texts)
    stored = {}
    for r in rows:
        payload = media.pad(texts[r["doc_id"]])
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(payload), cases.sha(payload), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == r["stored_sha256"] and (r["width"], r["height"] * 64, r["bit_depth"] if "bit_depth" in r else 8) == (64, len(payload), 8)
        assert stored.setdefault(payload, (r["stored_sha256"], r["feature"])) == (r["stored_sha256"], r["feature"])


def test_media_shards_are_tar_and_roll_over(spark, monkeypatch, tmp_path):
    import io
    import tarfile

    monkeypatch.setattr(media, "SHARD_BYTES", 4096)
    docs = cases.documents(spark).coalesce(1)
    index = media.write_media(docs, f"file://{tmp_path}/shards").collect()
    files = sorted((tmp_path / "shards").glob("*.tar"))
    members = {}
    for f in files:
        with tarfile.open(fileobj=io.BytesIO(f.read_bytes())) as t:
            for m in t.getmembers():
                members[f.name, m.offset_data] = (m.name, m.size)
    assert {(r["shard"], r["media_offset"]) for r in index} == set(members)
    assert all(members[r["shard"], r["media_offset"]] == (r["media_sha256"] + ".png", r["media_bytes"]) for r in index)


def plain_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of an 8-bit grey PNG, any row filter, by the format's definition."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, head, body = 8, b"", b""
    while True:
        n = int.from_bytes(data[at : at + 4], "big")
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + part)
        head, body = (part if kind == b"IHDR" else head), body + (part if kind == b"IDAT" else b"")
        at += 12 + n
        if kind == b"IEND":
            break
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    assert head[8:] == bytes([8, 0, 0, 0, 0])
    raw, out, above = zlib.decompress(body), [], [0] * width
    for y in range(height):
        kind, line = raw[y * (width + 1)], list(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for i in range(width):
            left, up, corner = (line[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line[i] = (line[i] + (0, left, up, (left + up) // 2, paeth)[kind]) % 256
        out += line
        above = line
    assert at == len(data)
    return width, height, bytes(out)


def plain_feature(payload: bytes) -> str:
    import math
    from collections import Counter

    n, mean = len(payload), sum(payload) / len(payload)
    bits = ""
    for k in range(64):
        cell = payload[k * n // 64 : (k + 1) * n // 64]
        bits += "1" if sum(cell) / len(cell) > mean else "0"
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    return f"{int(bits, 2):016x}:{mean:.3f}:{entropy:.4f}"


def test_op1_against_plain_python(spark, tmp_path):
    docs = cases.documents(spark).unionByName(cases.documents(spark).limit(6))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = media.op1_media_columns(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == docs.count() and {r["doc_id"] for r in rows} == set(texts)
    root = sorted((f for f in FOLDERS if "/media-" in f and "index" not in f and "stored" not in f and "others" not in f), key=FOLDERS.index)[-1]
    reader, places = ShardReader(root), {}
    for r in rows:
        payload = media.pad(texts[r["doc_id"]])
        stored = reader.read(r["shard"], r["media_offset"], r["media_bytes"])
        assert cases.sha(stored) == r["media_sha256"] and plain_png(stored) == (64, len(payload) // 64, payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(payload), cases.sha(payload), zlib.crc32(payload[-64:]))
        whole, mean, entropy = r["feature"].split(":")
        want = plain_feature(payload).split(":")
        assert whole == want[0] and float(mean) == pytest.approx(float(want[1]), abs=2e-3) and float(entropy) == pytest.approx(float(want[2]), abs=2e-4)
        # equal texts are stored once, whatever task saw them
        assert places.setdefault(payload, (r["shard"], r["media_offset"])) == (r["shard"], r["media_offset"])


def test_media_empty(spark):
    root = work_dir(spark, "t-media")
    assert media.media_columns(cases.documents(spark, []), root).count() == 0


# WARC -------------------------------------------------------------------------------------------------------------


def archive(spark, rows):
    crawl, root = work_dir(spark, "t-crawl"), work_dir(spark, "t-warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    return warc.read_archives(warc.write_deduplicated(warc.resolve(warc.write_crawl(pages.repartition(3), crawl)), crawl, root), root).collect()


def test_warc_revisits(spark):
    import hashlib

    big, other, small = "é" * 600, "x" * 1000, "y" * 999
    rows = [(5, "http://a", big), (9, "http://b", big), (2, None, big), (1, "u\nv", other), (3, "c", small), (4, "d", small), (6, "e", None), (7, "f", ""), (8, "g", other + "z\r\n\r\nmore")]
    got = {r["page_id"]: r for r in archive(spark, rows)}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        data, r = (html or "").encode(), got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if page_id in (5, 2) else ("response", None))


def test_warc_repeated_rows_and_empty(spark):
    page = "p" * 2000
    got = archive(spark, [(1, "a", page), (1, "a", page), (None, "n", page), (None, "m", "q" * 2000)])
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "revisit", 1)]
    assert archive(spark, []) == []


def test_warc_hot_digest(spark):
    got = archive(spark, [(i, "u", "h" * 1500) for i in range(300)])
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] < 299) == [("revisit", 299)] * 299


# SimHash ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, shingle=3):
    import xxhash

    w = cases.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64(b" ".join(w[i : i + shingle]), seed=42).intdigest() for i in range(max(1, len(w) - shingle + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_cover():
    masks = simhash.covering_masks()
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_simhash_against_brute_force(spark):
    docs = cases.with_clashes(cases.documents(spark))
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    links = {i: {j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2} for i in fps}
    want = cases.components(links)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in got} == {i: (fps[i], want[i]) for i in fps}


def test_links_of_dense_groups(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(120):
            values.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64) if rng.random() < 0.4 else 0
    values |= {rng.getrandbits(64) for _ in range(50)}
    links = {i: {j for j in values if (i ^ j).bit_count() <= 2} for i in values}
    want = cases.components(links)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(df)).collect()}
    got |= {r: r for r in got.values()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_simhash_repeated_rows_and_empty(spark):
    assert simhash.near_duplicates(cases.documents(spark, [])).count() == 0
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (9, "A B C D"), (7, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()) == [(4, 4), (4, 4), (7, 7), (9, 4)]


def test_stage_removes_copies_and_near_copies_only(spark):
    rng = random.Random(4)
    base = [cases.prose(rng, 200, 4000) for _ in range(12)]
    texts = [*base]
    for i, b in enumerate(base[:8]):
        w = b.split()
        for k in range(1 + i % 3):  # 3 changed words of 200 leave over 0.8 of the five-word shingles
            w[20 + 60 * k] = "other"
        texts.append(" ".join(w))
    texts += [base[0], base[0], base[9].upper(), " ".join(base[10].split()[:100] + base[11].split()[100:])]
    docs = cases.with_clashes(spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], cases.DOCS))
    out = simhash.without_near_copies(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == {*range(12), 23}
    assert simhash.without_near_copies(cases.documents(spark, [])).count() == 0
    assert simhash.without_near_copies(cases.documents(spark)).count() > 30


def test_stage_compares_members_that_match_no_leader(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.sample(words, 200)) for _ in range(16)]  # one set of words, so one bucket, in orders that share no shingle
    near = texts[15].split()
    near[60], near[61] = near[61], near[60]
    texts.append(" ".join(near))
    out = simhash.without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == set(range(16))


def test_stage_finds_copies_with_a_passage_more_or_less(spark):
    rng = random.Random(32)
    texts = [cases.prose(rng, 300, 4000) for _ in range(60)]
    for i in range(60):  # the shingle sets stay alike in 0.8 or more
        w = texts[i].split()
        texts.append(" ".join(w[:247] if i % 2 else w[:150] + cases.prose(rng, 60, 4000).split() + w[150:]))
    out = simhash.without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == set(range(60))


def exact_groups(texts, similarity=0.8):
    """Groups of indexes of texts whose sets of five-word shingles are alike, by an inverted index over all of them."""
    import collections

    sets = []
    for t in texts:
        w = cases.words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links = {i: {i} for i in range(len(texts))}
    for i, s in enumerate(sets):
        both = collections.Counter(j for x in s for j in holders[x] if j < i)
        for j, n in both.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                links[i].add(j), links[j].add(i)
    return cases.components(links)


@pytest.mark.parametrize("table", ["sf0.01", "edited"])
def test_stage_equals_an_exact_join(spark, table):
    if table == "sf0.01":
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    else:  # chains of edits, inserted passages, cut ends
        rng = random.Random(77)
        texts = []
        for _ in range(25):
            w = [f"x{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
            for _ in range(rng.randrange(1, 9)):
                texts.append(" ".join(w))
                at = rng.randrange(len(w))
                w = [w[:at] + [f"y{rng.randrange(5000)}"] + w[at + 1 :], w[:at] + [f"z{rng.randrange(5000)}" for _ in range(len(w) // 12)] + w[at:], w[: len(w) - len(w) // 11]][rng.randrange(3)]
        docs = cases.documents(spark, texts)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    root = exact_groups([t for _, t in rows])
    assert {r["doc_id"] for r in simhash.without_near_copies(docs).collect()} == {rows[i][0] for i in set(root.values())}


def test_stage_with_hundreds_of_unlike_members_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE", 16)
    rng = random.Random(41)
    shared = cases.prose(rng, 150, 4000)  # a passage in all: similar in 0.6 or so, so many least hashes agree
    texts = [f"{shared} {cases.prose(rng, 45, 4000)}" for _ in range(250)]
    near = texts[140].split()
    near[170] = "changed"
    texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.without_near_copies(docs).collect()} == set(range(250))


def written(spark):
    """Bytes and rows that this session has written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return np.array([(x.shuffleWriteBytes(), x.shuffleWriteRecords()) for x in (stages.apply(i) for i in range(stages.size()))]).sum(0)


def test_stage_shuffles_no_texts_without_candidates(spark):
    rng = random.Random(43)
    texts = [cases.prose(rng, 3000, 50000) for _ in range(120)]
    near = texts[60].split()
    near[1000] = "changed"
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(near), texts[7]])), "doc_id long, text string").localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        before = written(spark)
        assert {r["doc_id"] for r in simhash.without_near_copies(docs).collect()} == set(range(120))
        assert (written(spark) - before)[0] < 0.25 * sum(map(len, texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("counted", [1, 8])
def test_wide_buckets_are_split_by_first_shingles_only(spark, monkeypatch, counted):
    monkeypatch.setattr(simhash, "COUNTED", counted, raising=False)
    rng = np.random.default_rng(44)
    common, sets = rng.integers(0, 1 << 63, 120, np.uint64), []
    for i in range(300):  # a passage in all, and copies that differ in some shingles, about as much as may be
        own = rng.integers(0, 1 << 63, int(rng.integers(20, 90)), np.uint64) if i % 3 else sets[i - 2][120:] if i > 2 else common[:0]
        sets.append(np.concatenate([common, own[: len(own) - int(rng.integers(0, 8))], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), np.uint64)]))
    rows = spark.createDataFrame([(i, np.unique(x).tobytes(), 8 * len(np.unique(x))) for i, x in enumerate(sets)], "node long, hashes binary, size int").localCheckpoint()
    before = written(spark)
    out = simhash.split_wide(rows.select(F.lit(1).alias("key"), "node", F.lit(True).alias("own")), rows, 0.8)
    assert (written(spark) - before)[1] < 0.7 * sum(map(len, sets))
    buckets = {}
    for r in out.collect():
        buckets.setdefault(r["key"], {}).setdefault(r["node"], False)
        buckets[r["key"]][r["node"]] |= r["own"]
    meet = {(a, b) for x in buckets.values() for a in x for b in x if a < b and (x[a] or x[b])}
    held = [set(x.tolist()) for x in sets]
    want = {(a, b) for b in range(300) for a in range(b) if 10 * len(held[a] & held[b]) >= 8 * len(held[a] | held[b])}
    assert want and want <= meet and len(meet) < 45000 * 0.9


def test_stage_with_repeated_and_null_ids(spark):
    rng = random.Random(42)
    a, b, c, d = (cases.prose(rng, 80, 4000) for _ in range(4))
    rows = [(5, a, 0), (5, b, 0), (2, a, 0), (1, c, 0), (1, c, 0), (1, c, 1), (None, d, 0), (None, d, 0), (None, b + " more", 0), (7, None, 0), (8, "", 0), (9, " ", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("tags", F.array(F.lit("x"))).withColumn("row_hash", F.lit("own")).withColumn("m", F.create_map(F.lit("k"), F.col("n")))
    out = simhash.without_near_copies(docs)
    assert out.columns == docs.columns
    # no unique text is lost, whatever its id; of equal rows one stays, and a null id gives way to others
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == sorted([(False, 2, a), (False, 5, b), (False, 1, c), (True, 0, d), (False, 7, "")])


# Mixing -----------------------------------------------------------------------------------------------------------


def water_filled(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(cap * sizes[s] for s in capped)) / max(1, sum(w[s] for s in free))
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else w[s] * level for s in order}
        capped |= over


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = []
    for source, n, most in (("a", 300, 400), ("b", 40, 3000), (None, 60, 200), ("c", 5, 30), ("Z", 200, 50), ("é", 1, 900)):
        rows += [(len(rows) + i, " ".join(["x"] * rng.randrange(most)), None, source, 0) for i in range(n)]
    docs = cases.with_clashes(spark.createDataFrame(rows, cases.DOCS))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = water_filled(sizes)
    for source, target in want.items():
        mine = [r for r in got if r["source"] == source]
        assert all(r["source_size"] == sizes[source] and abs(r["target"] - target) < 1e-6 * max(1, target) for r in mine)
        assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in mine)
        # whole copies: no farther off than a hundredth, or half the largest document of a source of few
        assert abs(sum(r["taken"] for r in mine) - target) <= max(0.01 * target, max(r["size"] for r in mine) / 2 if len(mine) < 10 else 0)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_mixing_edges(spark):
    assert mixing.mix(cases.documents(spark, [])).count() == 0
    assert mixing.mix_documents(cases.documents(spark, [])).count() == 0
    none = mixing.mix(cases.documents(spark, [None, "", " "])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 3
    got = mixing.mix(cases.documents(spark)).collect()
    assert len(got) == len(cases.awkward_texts()) and all(r["taken"] == 0 for r in got if not r["size"])
    plan = mixing.mix(cases.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Packing ----------------------------------------------------------------------------------------------------------


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [*cases.awkward_texts(), "don't STOP's İİ. ÀB.,c 12ab. <|endoftext|> x<|startoftext|>y ²½ 你好，世界。 '' 's \x85\x1c", "w. " * 5000]
    docs = cases.with_clashes(cases.documents(spark, texts)).repartition(3)
    tok = Tokenizer.from_file(packing.default_vocabulary())
    want = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs).orderBy("doc_id", "start").collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    got: dict = {}
    for r in rows:
        assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["doc_tokens"] == len(want[r["doc_id"]])
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert got == want
    assert packing.digest(packing.pack(docs)).where("ids_crc32 is null").count() == 0
    assert packing.pack(cases.documents(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(twice).select("sequence_id").distinct().count() == packing.pack(twice).count()


def test_encoder_against_the_tokenizer_on_awkward_words(monkeypatch):
    import random

    rng = random.Random(3)
    letters = "ab'Zé́ß1 .,!&<|>_-\u2003\u00a0字ǅ🙂\t\n\x1c\x85İ—٣"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> a", "don't it's.'s", "", None]
    monkeypatch.setattr(packing, "WORD_CACHE", 500)  # the memory starts anew now and then
    words = packing.WordEncoder(packing.default_vocabulary())
    for i in range(0, len(texts), 90):
        flat, counts = words.encode(pa.array(texts[i : i + 90], pa.string()))
        want = [[*words.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts[i : i + 90]]
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_op8_buckets_hold_one_length(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = cases.documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.op8_binary_pack(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    table = packing.write_buckets(packing.pack(docs), f"{tmp_path}/buckets")
    key = lambda d: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in d.collect())
    assert key(packing.digest(table)) == key(out) == key(packing.digest(packing.pack(docs)))
    folders = glob.glob(f"{tmp_path}/buckets/length=*")
    assert len(folders) == len({r["length"] for r in out.collect()})
    for f in folders:
        for part in glob.glob(f"{f}/*.parquet"):
            assert {len(x) for x in pq.ParquetFile(part).read().column("ids").to_pylist()} == {4 * int(f.rsplit("=", 1)[1])}


# Language ---------------------------------------------------------------------------------------------------------


def naive_bits(trained: list[bytes], text: bytes) -> float:
    """Method C without exclusions, straight from the definition."""
    from collections import Counter, defaultdict

    counts = [defaultdict(Counter) for _ in range(4)]
    data = b"".join(b"\n\n\n" + t for t in trained) + b"\n\n\n"
    for n in range(4):
        for i in range(n, len(data)):
            counts[n][data[i - n : i]][data[i]] += 1

    def p(context: bytes, c: int) -> float:
        n = len(context)
        seen = counts[n].get(context)
        lower = p(context[1:], c) if n else 1 / 256
        if not seen:
            return lower
        total, kinds = sum(seen.values()), len(seen)
        if n == 0:
            return (seen[c] + kinds / 256) / (total + kinds)
        return seen[c] / (total + kinds) if seen[c] else kinds / (total + kinds) * lower

    padded = b"\n\n\n" + text
    return sum(-np.log2(p(padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))


def test_code_lengths_are_exact():
    sets = {"x": [b"the cat sat on the mat", b"then that"], "y": ["der Hund über die Brücke".encode(), b"die die"]}
    trees = langid.ContextTrees(sets)
    texts = [b"the hat", b"die Katze", b"zzz qqq", b"", b"a", bytes(range(1, 60)), "Brücke über".encode()]
    got = trees.lengths(texts)
    for i, t in enumerate(texts):
        for j, k in enumerate(trees.languages):
            assert got[i, j] == pytest.approx(naive_bits(sets[k], t), rel=1e-4, abs=1e-3)


def test_language_held_out_accuracy_and_edges(spark):
    rng = random.Random(6)
    vocab = {"en": ["the", "and", "thing", "with", "where"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["le", "été", "que", "nous", "où"]}
    rows = [(i, " ".join(rng.choices(vocab[k], k=rng.randrange(3, 40))), k) for i, k in enumerate(rng.choices(list(vocab), k=300))]
    rows += [(300, None, "en"), (301, "", "de"), (302, "12 .. %", "fr"), (303, "the and", None)]
    docs = cases.with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    trees = langid.train(docs, keep=~langid.held_out(F.col("doc_id")))
    out = langid.predict(docs, trees)
    assert out.columns == [*docs.columns, "_language"]
    got = {r["doc_id"]: r["_language"] for r in out.collect()}
    out_of_sample = [i for i, _, _ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out_of_sample) > 40
    assert sum(got[i]["pred"] == rows[i][2] for i in out_of_sample) >= 0.98 * len(out_of_sample)
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert [got[i]["pred"] for i in (300, 301, 302, 303)] == ["und", "und", "und", "en"]
    empty = docs.limit(0)
    nothing = langid.train(empty)
    assert langid.predict(empty, nothing).count() == 0
    assert {r["_language"]["pred"] for r in langid.predict(docs.limit(5), nothing).collect()} == {"und"}


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = random.Random(15)
    trees = langid.ContextTrees({"x": [b"abc abd abe"], "y": [b"zyx zyw"]})
    texts = [b"", b"ab", bytes(rng.choices(b"abcdez y", k=1000)), b"abc", bytes(rng.choices(b"abz", k=257))]
    whole = trees.lengths(texts)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.allclose(trees.lengths(texts), whole)


def test_all_of_many_languages_are_learned(spark):
    rng = random.Random(16)
    words = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(12)] for k in range(100)}
    rows = [(i, " ".join(rng.choices(words[k], k=40)), k) for i, k in enumerate(list(words) * 8)]
    # a language of long texts only, longer than the sample's bytes
    rows += [(5000 + i, " ".join(rng.choices(["lang", "und", "breit"], k=40_000)), "long") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.train(docs, sample_bytes=20_000)
    assert set(trees.languages) == {*words, "long"}
    probe = spark.createDataFrame([(i, " ".join(rng.choices(words[k], k=30)), k) for i, k in enumerate(words)] + [(200, "und breit und lang", "long")], "doc_id long, text string, lang string")
    got = langid.predict(probe, trees).collect()
    assert sum(r["language"]["pred"] == r["lang"] for r in got) >= 0.98 * len(got)


# Importance resampling --------------------------------------------------------------------------------------------


def test_weights_against_the_definition(spark):
    docs = cases.with_clashes(cases.documents(spark))
    ids = [r["doc_id"] for r in docs.collect()]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0)) for i in ids[:30]] + [(None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in ids[:30] if i % 3 == 0 and i % 5}
    hasher = importance.Hasher(importance.BUCKETS)
    feats = {r["doc_id"]: hasher.features([(r["text"] or "").encode()])[0] for r in docs.collect()}
    raw, target = (np.bincount(np.concatenate([feats[i] for i in some]), minlength=importance.BUCKETS) for some in (ids, good))
    lp = lambda c: np.log((c + 1) / (c.sum() + len(c)))
    ratio = lp(target) - lp(raw)
    rows = importance.resample(docs, labels, keep_share=0.5).collect()
    assert len(rows) == len(ids)
    for r in rows:
        assert r["log_weight"] == pytest.approx(ratio[feats[r["doc_id"]]].sum(), abs=1e-6)
    keys = sorted((r["gumbel_key"] for r in rows), reverse=True)
    least = keys[-(-len(ids) // 2) - 1]
    assert all(r["keep"] == (r["gumbel_key"] >= least) for r in rows)


def test_resampling_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(cases.documents(spark, []), labels).count() == 0
    rows = importance.resample(cases.documents(spark), labels).collect()
    assert {r["log_weight"] for r in rows} == {0.0}


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1e3) for _ in range(3000)] + [5.0] * 500 + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 1750, 2000, 3501, 3502):
        assert importance.kth_largest(df, "x", k) == order[k - 1]
    assert importance.kth_largest(df.limit(0), "x", 3) is None


# Nearest neighbours -----------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    df = vectors(spark, [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]).withColumn("shard", F.lit("own"))
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x, hits = x.astype(float), 0
    assert set(got) == set(range(0, 3000, 20))
    for q, rows in got.items():
        score = x @ x[q]
        assert [k for k, _, _ in rows] == list(range(1, 21)) and q not in {v for _, v, _ in rows}
        assert all(s == pytest.approx(score[v], abs=1e-12) for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        score[q] = -np.inf
        hits += len({v for _, v, _ in rows} & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_awkward_vectors(spark):
    good = [(i, [1.0, float(i)], 0) for i in range(1, 6)] + [(20, [1.0, 2.0], 0), (40, [1.0, 2.0], 0), (40, [1.0, 2.0], 0)]
    bad = [(60, None, 0), (80, [], 0), (100, [0.0, 0.0], 0), (120, [1.0, None], 0), (140, [float("nan"), 1.0], 0), (160, [float("inf"), 1.0], 0), (180, [1.0], 0), (None, [1.0, 1.0], 0)]
    rows = ann.nearest(vectors(spark, good + bad), F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in rows} == {20, 40}
    mine = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 20)
    assert [v for _, v in mine][:3] == [5, 4, 3] and {v for _, v in mine} == {1, 2, 3, 4, 5, 40}
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    same = vectors(spark, [(i, [1.0, 1.0], 0) for i in range(200)])
    ties = [r["vec_id"] for r in ann.nearest(same, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert ties == list(range(1, 21))


def test_more_shards(spark):
    rng = np.random.default_rng(3)
    df = vectors(spark, [(i, [float(v) for v in rng.normal(size=8)], 0) for i in range(1000)])
    assert ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=90).count() == 1000


def test_repeated_ids_are_one_query_and_one_candidate(spark):
    rng = np.random.default_rng(4)
    x = [[float(v) for v in rng.normal(size=6)] for _ in range(60)]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(20, x[20], 1), (20, x[21], 0), (7, [-v for v in x[7]], 0), (7, x[7], 0)]
    got: dict = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    single = {}
    for i, v, _ in rows:
        single.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    assert set(got) == {0, 20, 40}
    for q, answers in got.items():
        mine = min(single[q], key=list)
        want = sorted((-max(float(v @ mine) for v in vs), i) for i, vs in single.items() if i != q)[:20]
        assert [(k, v) for k, v, _ in answers] == [(n + 1, i) for n, (_, i) in enumerate(want)]
        assert all(s == pytest.approx(-w[0], abs=1e-12) for (_, _, s), w in zip(answers, want, strict=True))


def test_all_candidates_are_found_if_they_are_few(spark):
    rng = np.random.default_rng(11)
    for n in (1, 2, 5, 15, 20, 21):
        x = rng.normal(size=(2, 5))[rng.integers(0, 2, n)] * 50 + rng.normal(size=(n, 5))
        df = vectors(spark, [(i, [float(v) for v in row], 0) for i, row in enumerate(x)])
        assert ann.nearest(df, F.col("vec_id") == 0).count() == min(20, n - 1)


def test_graph_points_are_reachable():
    rng = np.random.default_rng(12)
    for n in (3, 21, 64, 150, 400):
        x = rng.normal(size=(3, 8))[rng.integers(0, 3, n)] * 20 + rng.normal(size=(n, 8))
        found = ann.Graph(x).search(np.zeros((1, 9)), n)[0]
        assert (found >= 0).sum() >= 0.99 * n


def test_op10_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    found: dict = {}
    for r in ann.op10_pruned_graph(spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, mine in found.items():
        score = np.where(ids == q, -np.inf, x @ rows[q])
        hits += len(mine & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_ann_recall_in_the_largest_shard():
    n = ann.SHARD_ROWS
    assert n <= 10_000  # larger ones have not been measured
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, n)] + rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.Shard(np.arange(n), x).answer(np.arange(200), x[:200], 20)
    found = set(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    scores = x[:200] @ x.T
    scores[np.arange(200), np.arange(200)] = -np.inf
    assert np.mean([(q, v) in found for q in range(200) for v in np.argsort(-scores[q])[:20].tolist()]) >= 0.9
