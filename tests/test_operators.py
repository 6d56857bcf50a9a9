"""Cases with known answers, edge cases, and folds against plain loops."""

import hashlib
import hmac
import random
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.functions import codes, hashing, paths
from quarry.operators import erasure, feeds, ledgers, namespace, needles, policies, topology
from quarry.plans.rewrite import next_prefix, prefix_range
from quarry.sources import volumes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(spark, make, *values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in frame.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_paths(spark):
    assert text(spark, paths.parent_dir, "/", "/a", "/a/b", "a", "/a/b/") == ["/", "/", "/a", "/", "/a/b"]
    assert text(spark, paths.base_name, "/", "/a", "/a/b", "a") == ["", "a", "b", "a"]
    assert text(spark, paths.clean_path, "", "/", "a//b/./c", "/../x", "/a/../../b", "/a/b/..") == ["/", "/", "/a/b/c", "/x", "/b", "/a"]
    assert text(spark, paths.bucket_of, "b", "b/k", "/b/k/l", "") == ["b", "b", "b", ""]
    assert text(spark, paths.key_of, "b", "b/k", "/b/k/l", "b/") == ["", "k", "k/l", ""]
    assert text(spark, paths.ancestors, "/a/b/c", "/a") == [["/a", "/a/b"], []] or text(spark, paths.ancestors, "/a/b/c") == [["/a", "/a/b"]]
    assert text(spark, paths.valid_name, "a", "", "x" * 255, "x" * 256, "a/b", "..", "é" * 128) == [True, False, True, False, False, False, False]
    assert text(spark, paths.hidden, "a/.b/c", ".a", "a.b", "a/b") == [True, True, False, False]


def test_file_ids(spark):
    good, bad = "3,0123456789abcdef01020304", ["", "3", "x,0123456789", "3,12345678", "3,xyz456789", "4294967296,0123456789", "3," + "1" * 25]
    p = text(spark, codes.parse_file_id, good, "1,100000000", *bad)
    assert (p[0].vid, p[0].needle, p[0].cookie) == (3, Decimal(0x0123456789ABCDEF), 0x01020304)
    assert (p[1].vid, p[1].needle, p[1].cookie) == (1, 1, 0)
    assert p[2:] == [None] * len(bad)
    assert one(spark, codes.parse_file_id(F.lit("7,fedcba987654321000000001")))["needle"] == Decimal(0xFEDCBA9876543210)
    assert one(spark, codes.format_file_id(F.lit(3), F.lit(0x123), F.lit(9))) == "3,000000000000012300000009"
    assert text(spark, codes.volume_of, "12", "12,0000000001", "x", "") == [12, 12, None, None]


def test_codes(spark):
    assert text(spark, codes.ttl_seconds, "", "3m", "4h", "5d", "6w", "7M", "8y", "256d", "3x", "m", "-1d", "3D") == [0, 180, 14400, 432000, 3628800, 18144000, 252288000, None, None, None, None, None]
    p = text(spark, codes.placement_of_text, "000", "123", "1a3", "12")
    assert [x and tuple(x) for x in p] == [(0, 0, 0), (1, 2, 3), None, None]
    for a, b, c in ((0, 0, 0), (7, 7, 3), (1, 2, 3)):
        byte = codes.placement_byte(F.lit(a), F.lit(b), F.lit(c))
        assert one(spark, byte) == a << 5 | b << 2 | c and tuple(one(spark, codes.placement_parts(byte))) == (a, b, c)
    assert [one(spark, codes.padding(F.lit(n))) for n in (0, 1, 8, 15)] == [0, 7, 0, 1]
    assert text(spark, codes.grpc_address, "h:8080", "h:8080.777") == ["h:18080", "h:777"]
    assert text(spark, codes.http_address, "h:18080") == ["h:8080"]
    assert text(spark, codes.ipv4, "0.0.0.0", "255.255.255.255", "1.2.3", "1.2.3.256", "1.2.3.4.", "a") == [0, 2**32 - 1, None, None, None, None]
    assert one(spark, codes.version_id(F.lit(1704067200000000000))) == "cy37tz8jqw3k" or int(one(spark, codes.version_id(F.lit(1704067200000000000))), 36) == 1704067200000000000
    assert [one(spark, codes.backoff_ms(F.lit(i))) for i in (0, 1, 5, 6, 40)] == [500, 1000, 16000, 30000, 30000]
    assert [one(spark, codes.percent_done(F.lit(a), F.lit(b))) for a, b in ((0, 10), (5, 10), (99, 10), (1, 0), (-3, 9))] == [0, 50, 100, 100, 0]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("photos/*", ["photos/a", "photos/a/b"], ["docs/a", "photos"]), ("*.jpg", ["a.jpg"], ["d/a.jpg", "a.png"]), ("a?c", ["abc"], ["a/c", "abbc"]), ("[a-c]x", ["bx"], ["dx"]), ("[^a]x", ["bx"], ["ax"]), (r"\*x", ["*x"], ["ax"]), ("a*/b*", ["ax/by"], ["a/x/b"])],
)
def test_globs(pattern, yes, no):
    import re

    own = re.compile(codes.glob_to_regex(pattern))
    assert all(own.search(t) for t in yes) and not any(own.search(t) for t in no)


def test_hashes(spark):
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325 - 2**64 and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C - 2**64
    assert text(spark, hashing.fnv1a_64, "/", None) == [hashing.fnv1a(b"/"), None]
    assert one(spark, F.crc32(F.lit("abc"))) == zlib.crc32(b"abc")
    key = hashing.signing_key("secret", "20240101", "us-east-1")
    assert one(spark, hashing.signature(F.lit("secret"), F.lit("20240101"), F.lit("us-east-1"), F.lit("text"))) == hmac.new(key, b"text", hashlib.sha256).hexdigest()
    headers = F.create_map(F.lit("host"), F.lit(" a  b "), F.lit("x"), F.lit("1"))
    request = one(spark, hashing.canonical_request(F.lit("GET"), F.lit("/p"), F.lit("b=2&a&X-Amz-Signature=z"), headers, F.lit("host;x"), F.lit("h")))
    assert request == "GET\n/p\na=&b=2\nhost:a b\nx:1\n\nhost;x\nh"
    assert one(spark, hashing.string_to_sign(F.lit("t"), F.lit("s"), F.lit("r"))) == "AWS4-HMAC-SHA256\nt\ns\n" + hashlib.sha256(b"r").hexdigest()
    assert hashing.split_command("""fs.ls "a b" 'c "d' e\\ f ''""") == ["fs.ls", "a b", 'c "d', "e f", ""]
    with pytest.raises(ValueError):
        hashing.split_command("a 'b")


def test_prefix_ranges(spark):
    assert next_prefix("ab") == "ac" and next_prefix("a\U0010ffff") == "b" and next_prefix("\U0010ffff") is None and next_prefix("a퟿") == "a"
    frame = spark.createDataFrame([("a%",), ("ab",), ("a",), ("b",), ("a%c",)], "v string")
    assert sorted(r.v for r in frame.where(prefix_range(F.col("v"), "a%")).collect()) == ["a%", "a%c"]  # wildcards are literal
    plan = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(prefix_range(F.col("o_orderstatus"), "F"))._jdf.queryExecution().toString()
    assert "StringStartsWith" in plan and "GreaterThanOrEqual" in plan


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("/a", "x", 1, 5), ("/a", "y", 2, 5), ("/a", ".h", 3, 5), ("/a/b", "z", 4, 5), ("/ab", "q", 5, 5), ("/a", "b", 0, 5)]
    return spark.createDataFrame(rows, "dir string, name string, file_size long, mtime_sec long")


def names(frame):
    return [f"{r.dir}/{r.name}" for r in frame.collect()]


def test_pages(spark, entries):
    first = namespace.list_directory(entries, "/a", limit=2)
    assert names(first) == ["/a/.h", "/a/b"] and namespace.next_cursor(first).first().cursor == "b"
    assert names(namespace.list_directory(entries, "/a", start="b", limit=2)) == ["/a/x", "/a/y"]
    assert names(namespace.list_directory(entries, "/a", start="b", include_start=True)) == ["/a/b", "/a/x", "/a/y"]
    assert namespace.list_directory(entries, "/none").count() == 0


def test_stored_entries_are_pruned(spark, tmp_path):
    from quarry.sources.tables import table, write_entries

    write_entries(table(spark, "/root/testdata/sf0.01", "f_entries"), str(tmp_path / "e"), 8)
    stored = spark.read.parquet(str(tmp_path / "e"))
    page = namespace.list_directory(stored, "/buckets/src1/en", start="doc-00000100", prefix="doc-", limit=5).select("name", "file_size")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = page._jdf.queryExecution().toString()
    assert "EqualTo(dir,/buckets/src1/en)" in plan and "GreaterThan(name,doc-00000100)" in plan and "StringStartsWith(name,doc-)" in plan
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0] and "TakeOrderedAndProject" in plan
    files = {r.f for r in stored.where("dir = '/buckets/src1/en'").select(F.input_file_name().alias("f")).collect()}
    assert len(files) <= 2 < len(list((tmp_path / "e").glob("*.parquet")))


def test_deletes_and_renames(entries):
    assert sorted(names(namespace.delete_children(entries, "/a"))) == ["/ab/q"]
    assert sorted(names(namespace.delete_tree(entries, "/a/b"))) == ["/a/.h", "/a/x", "/a/y", "/ab/q"]
    assert "/n/x2" in names(namespace.rename(entries, ("/a", "x"), ("/n", "x2"))) and entries.count() == namespace.rename(entries, ("/a", "x"), ("/n", "x2")).count()
    assert namespace.rename(entries, ("/a", "x"), ("/a", "y")).count() == entries.count() - 1  # what stood there is replaced
    assert "/a/b/z" in names(namespace.rename(entries, ("/a", "b"), ("/a", "c")))  # children are not moved
    assert "/a/c/z" in names(namespace.rename(entries, ("/a", "b"), ("/a", "c"), children=True))
    assert [r.path for r in namespace.export_tree(entries, "/a").collect()] == ["/a", "/a/.h", "/a/b", "/a/b", "/a/b/z", "/a/x", "/a/y"]


def test_bulk_delete_limits(spark):
    objects = spark.createDataFrame([("k1",), ("k2",)], "key string")
    left, said = namespace.bulk_delete(objects, spark.createDataFrame([("k1",), ("",), ("gone",)], "key string"))
    assert [r.key for r in left.collect()] == ["k2"] and sorted(r.key for r in said.collect()) == ["gone", "k1"]
    with pytest.raises(ValueError):
        namespace.bulk_delete(objects, spark.range(1001).select(F.col("id").cast("string").alias("key")))


def test_index_replay(spark):
    log = spark.createDataFrame([(1, 1, 7, 100), (2, 1, 7, 50), (3, 1, 8, 30), (4, 1, 8, 0), (5, 1, 8, 0), (6, 1, 9, 0)], "pos long, vid long, needle_key long, size long")
    assert needles.index_stats(log).first().asDict() == {"vid": 1, "file_count": 1, "content_bytes": 50, "deleted_count": 2}
    g = needles.garbage(log).first()
    assert (g.deleted_bytes, g.ratio) == (30, 30 / 80)
    assert needles.garbage(log, overwrites=True).first().deleted_bytes == 130
    assert needles.need_compaction(log, 0.4).count() == 0 and needles.garbage(log.limit(0)).count() == 0


def test_growth(spark):
    rows = [("a", i, "writable" if i < 89 else "readonly") for i in range(100)] + [("b", i, "writable") for i in range(50)]
    got = {r.c: (r.grow, r.to_add) for r in topology.layouts_to_grow(spark.createDataFrame(rows, "c string, vid long, state string")).collect()}
    assert got == {"a": (True, 10), "b": (False, 5)}
    assert [one(spark, topology.grow_count(F.lit(n))) for n in (0, 10, 100, 5)] == [1, 1, 10, 1]


def test_rename_finds_its_entry_wherever_it_stands(spark, tmp_path):
    from quarry import registry

    docs = spark.createDataFrame([(1, "src9", "fr", "a", 1), (2, "src1", "en", "b", 2), (1, "src1", "en", "c", 3)], "doc_id long, source string, lang string, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.queries()["k9_rename"](spark, str(tmp_path)).select("dir", "name", "file_size").collect())
    assert got == [("/buckets/moved", "renamed", 1), ("/buckets/moved", "renamed", 3), ("/buckets/src1/en", "doc-00000002", 2)]
    rows = spark.createDataFrame([(1, "/a", "x"), (2, "/n", "y"), (3, None, "y"), (None, "/b", "z")], "inode long, dir string, name string")
    moved = namespace.rename(rows, F.col("inode") == 1, ("/n", "y"))
    assert {tuple(r) for r in moved.collect()} == {(1, "/n", "y"), (3, None, "y"), (None, "/b", "z")}
    assert moved.count() == 3 and namespace.rename(moved, F.col("inode") == 1, ("/n", "y")).count() == 3
    with pytest.raises(ValueError):
        namespace.rename(rows, F.col("inode") == 1, ("/n", "y"), children=True)


def test_candidates_shuffle_no_pairs(spark):
    replicas = spark.createDataFrame([(1, 10), (1, 20), (1, 20), (2, 30), (3, 10), (3, 20), (3, 30), (4, None)], "vid long, node long")
    nodes = spark.createDataFrame([(10, 1), (20, 2), (30, 0), (40, 5), (40, 5), (None, 1)], "node long, free_slots long")
    lack = topology.census(replicas, F.lit(3))
    want = [(1, 40), (1, 40), (1, None), *[(v, n) for v in (2, 4) for n in (10, 20, 40, 40, None)]]
    key = lambda x: (x[0], x[1] or 0)
    for vids in (lack, lack.select("vid"), topology.census(replicas, F.lit(3), held=True)):
        found = topology.candidates(replicas, nodes, vids)
        assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
        before_pairs = found._jdf.queryExecution().sparkPlan().toString().split("NestedLoopJoin")[0]
        assert "Join" not in before_pairs and "Exchange" not in before_pairs
    never = spark.createDataFrame([(7,), (7,)], "vid long")
    assert topology.candidates(replicas, nodes, never).count() == 5  # a volume that nobody holds, asked about once


def test_candidates_by_blocks_of_nodes(spark, monkeypatch):
    held = {1: [3, 4, 5, 9], 2: [0, 49], 3: [], 5: [200], 6: list(range(50))}
    replicas = spark.createDataFrame([(v, n) for v, ns in held.items() for n in ns for _ in range(2)] + [(7, None)], "vid long, node int")
    rooms = [(n, n % 3) for n in range(50)] + [(4, 1), (4, 2), (49, 1), (None, 1), (None, 2), (None, 0)]
    nodes = spark.createDataFrame(rooms, "node long, free_slots long")
    vids = spark.createDataFrame([(1,), (2,), (2,), (3,), (5,), (6,), (7,)], "vid long")
    want = sorted((v, -1 if n is None else n) for v in (1, 2, 3, 5, 6, 7) for n, room in rooms if room and (n is None or n not in held.get(v, [])))
    for block, part in ((8, 16), (1, 1), (7, 1000), (1000, 1000)):
        monkeypatch.setattr(topology, "BLOCK", block)
        monkeypatch.setattr(topology, "PART", part)
        found = topology.candidates(replicas, nodes, vids)
        assert sorted((r.vid, -1 if r.target is None else r.target) for r in found.collect()) == want
        if block < 50:
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert "Exchange" not in plan.split("CartesianProduct")[0] and "NestedLoopJoin" not in plan


def test_candidates_are_written_small(spark, tmp_path):
    nodes = spark.range(60_000).selectExpr("id as node", "1 as free_slots")
    replicas = spark.range(60).selectExpr("id as vid", "explode(array(id * 7, id * 900)) as node")
    topology.candidates(replicas, nodes, topology.census(replicas, F.lit(3), held=True)).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 60 * 60_000 - 119  # volume 0 has one node
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 60 * 60_000  # over two bytes a pair where each volume met all nodes in turn


def test_placement(spark):
    nodes = [("n1", "d1", "r1"), ("n2", "d1", "r1"), ("n3", "d1", "r2"), ("n4", "d2", "r1"), ("n5", "d2", "r2")]
    asked = spark.createDataFrame([(1, 1, 1, 1, nodes), (2, 0, 0, 0, nodes), (3, 2, 0, 0, nodes), (4, 0, 3, 0, nodes), (5, 0, 0, 1, []), (6, 0, 0, 9, nodes)], "request_id long, copies_dc int, copies_rack int, copies_same int, candidates array<struct<node: string, dc: string, rack: string>>")
    got = {r.request_id: r.nodes for r in topology.place_copies(asked).collect()}
    assert got == {1: "n1,n4,n3,n2", 2: "n1", 3: "n1,n4,n5", 4: "n1,n3,n2,n4", 5: "", 6: "n1,n2,n3,n4,n5"}


def test_placement_needs_few_candidates(spark):
    rng = random.Random(6)
    asked = spark.createDataFrame([(i, d, r, s) for i, (d, r, s) in enumerate((d, r, s) for d in (0, 1, 3) for r in (0, 2) for s in (0, 1, 4))], "request_id long, copies_dc int, copies_rack int, copies_same int")
    for n_dc, n_rack, n in ((1, 1, 40), (1, 12, 60), (3, 4, 300), (2, 2, 3), (4, 1, 90)):
        where = [(f"n{i}", f"d{rng.randrange(n_dc)}", f"r{rng.randrange(n_rack)}") for i in range(n)]
        nodes = spark.createDataFrame(where + where[:2], "node string, dc string, rack string")
        few = topology.near_candidates(asked, nodes)
        assert {len(r.candidates) for r in few.collect()} <= set(range(5 * 10 + 1))
        every = asked.crossJoin(F.broadcast(nodes.distinct().agg(F.array_sort(F.collect_list(F.struct("node", "dc", "rack"))).alias("candidates"))))
        assert sorted(topology.place_copies(few).collect()) == sorted(topology.place_copies(every).collect())
    assert {(r.nodes, r.n) for r in topology.place_copies(topology.near_candidates(asked, nodes.limit(0))).collect()} == {("", 0)}
    assert topology.place_copies(topology.near_candidates(asked.limit(0), nodes)).count() == 0


def test_lifecycle(spark):
    now = 1773100800
    rules = spark.createDataFrame([(0, "logs/", 30, 0, "", "Enabled"), (1, "data/", 0, 90, "COLD", "Enabled")], "rule_idx int, prefix string, expire_days int, transition_days int, storage_class string, status string")
    objects = spark.createDataFrame([("logs/old.log", now - 40 * 86400), ("data/archive.bin", now - 120 * 86400), ("data/new.bin", now - 10 * 86400)], "path string, mtime_sec long")
    got = {r.path: (r.action, r.storage_class) for r in policies.lifecycle(objects, rules, now).collect()}
    assert got == {"logs/old.log": ("delete", None), "data/archive.bin": ("transition", "COLD"), "data/new.bin": ("keep", None)}
    exact = spark.createDataFrame([("logs/x", now - 30 * 86400)], "path string, mtime_sec long")
    assert policies.lifecycle(exact, rules, now).first().action == "keep"  # not older than the days


def test_many_rules_are_joined(spark, monkeypatch):
    from quarry.plans import rewrite

    rng, now = random.Random(4), 10**9
    rules = [(i, rng.choice(["a", "ab", "b", "", "abc"]), rng.choice([0, 10, 50]), rng.choice([0, 5, 20]), f"c{i}", rng.choice(["Enabled", "Disabled"])) for i in range(8)]
    frame = spark.createDataFrame(rules, "rule_idx int, prefix string, expire_days int, transition_days int, storage_class string, status string")
    objects = spark.createDataFrame([(f"{rng.choice('abc')}{rng.choice('abc')}{i}", now - rng.randrange(60) * 86400) for i in range(80)], "path string, mtime_sec long")
    config = spark.createDataFrame([("a", "1"), ("ab", "2"), ("b", "3")], "path_prefix string, v string")
    few = sorted(map(tuple, policies.lifecycle(objects, frame, now).collect()), key=repr), sorted(map(tuple, policies.longest_prefix(objects, config, {"v": "0"}).collect()))
    monkeypatch.setattr(policies, "is_small", lambda _: False)
    assert rewrite.is_small(config)
    assert few == (sorted(map(tuple, policies.lifecycle(objects, frame, now).collect()), key=repr), sorted(map(tuple, policies.longest_prefix(objects, config, {"v": "0"}).collect())))


def test_as_of_by_blocks(spark):
    rng = random.Random(8)
    sets = [(rng.randrange(3), rng.randrange(200)) for _ in range(30)]
    lookups = [(i, rng.randrange(4), rng.randrange(200)) for i in range(200)]
    want = set()
    for i, v, at in lookups:
        last = max((t for w, t in sets if w == v and t <= at), default=None)
        want.add((i, v, at, last, last is not None and at <= last + 20))
    for block in (10, 10**6):
        got = policies.cached_locations(spark.createDataFrame(lookups, "request_id long, vid long, at long"), spark.createDataFrame(sets, "vid long, at long"), 20, block)
        assert {tuple(r) for r in got.collect()} == want


def test_tiering(spark):
    frame = spark.createDataFrame([("ssd", 48, False), ("hdd", 240, False), ("ssd", 240, True), ("hdd", 48, False), ("ssd", 24, False)], "d string, h long, r boolean")
    got = [r.a for r in frame.select(policies.tiering(F.lit(10**9) - F.col("h") * 3600, F.col("d"), F.col("r"), 10**9, 24 * 3600, 168 * 3600).alias("a")).collect()]
    assert got == ["migrate", "archive", "migrate", None, "migrate"]


def test_config_rules(spark):
    rules = spark.createDataFrame([("/photos", "photo"), ("/photos/big", "big"), ("/videos", "video")], "path_prefix string, collection string")
    p = spark.createDataFrame([("/photos/a",), ("/photos/big/b",), ("/videos/c",), ("/other",)], "path string")
    assert {r.path: r.collection for r in policies.longest_prefix(p, rules, {"collection": ""}).collect()} == {"/photos/a": "photo", "/photos/big/b": "big", "/videos/c": "video", "/other": ""}


def test_access(spark):
    grants = spark.createDataFrame([("admin", "Admin"), ("reader", "Read"), ("putter", "s3:PutObject"), ("scoped", "s3:GetObject:photos/*"), ("star", "*")], "identity string, grant_str string")
    asked = [("admin", "s3:DeleteBucket", "x/y"), ("reader", "s3:GetObject", "x/y"), ("reader", "s3:PutObject", "x/y"), ("putter", "s3:PutObject", "x/y"), ("putter", "s3:GetObject", "x/y"), ("scoped", "s3:GetObject", "photos/a/b"), ("scoped", "s3:GetObject", "docs/a"), ("star", "any", "x"), ("nobody", "s3:GetObject", "x")]
    requests = spark.createDataFrame(asked, "identity string, action string, resource string")
    allowed = {tuple(r) for r in policies.authorize(requests, grants).collect()}
    assert allowed == {asked[0], asked[1], asked[3], asked[5], asked[7]}
    assert {tuple(r) for r in policies.deny(requests, grants).collect()} == set(asked) - allowed


def test_addresses(spark):
    asked = spark.createDataFrame([(1, "10.1.2.3"), (2, "11.0.0.1"), (3, "bad"), (4, None)], "request_id long, ip string")
    ids = lambda frame: sorted(r.request_id for r in frame.collect())
    lists = lambda *c: spark.createDataFrame([(x,) for x in c], "cidr string")
    assert ids(policies.allowed_addresses(asked, lists())) == [1, 2, 3, 4]
    assert ids(policies.allowed_addresses(asked, lists("10.0.0.0/8", "10.1.0.0/16", "nonsense"))) == [1]
    assert ids(policies.allowed_addresses(asked, lists("0.0.0.0/0"))) == [1, 2]


def test_quota(spark):
    log = spark.createDataFrame([(1, 1, 80), (1, 2, 10), (1, 3, -200), (1, 4, 5)], "user_id long, seq long, delta long")
    assert [r.used for r in ledgers.quota_ledger(log).orderBy("seq").collect()] == [80, 90, 0, 5]
    rng = random.Random(9)
    steps = [(rng.choice([1, 1, 1, 2]), i, rng.randint(-50, 45)) for i in range(500)]
    want, used = [], {1: 0, 2: 0}
    for u, i, d in steps:
        used[u] = max(0, used[u] + d)
        want.append((u, i, d, used[u]))
    frame = spark.createDataFrame(steps, "user_id long, seq long, delta long")
    for block in (7, 100, 10**6):
        assert sorted(map(tuple, ledgers.quota_ledger(frame, block).collect()), key=lambda r: r[1]) == want
    quotas = spark.createDataFrame([(1, 100, 80), (2, 0, 80)], "user_id long, max_bytes long, used_bytes long")
    asked = spark.createDataFrame([(1, 1, 30), (2, 1, 20), (3, 2, 10**9), (4, 9, 1)], "request_id long, user_id long, bytes long")
    assert {r.request_id: r.admitted for r in ledgers.quota_check(asked, quotas).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_folds(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), i, rng.randrange(60)) for i in range(600)]
    frame = spark.createDataFrame(rows, "user_id long, seq long, bytes long").repartition(7)
    used, want = {}, set()
    for u, s, b in rows:
        good = used.get(u, 0) + b <= 900
        used[u] = used.get(u, 0) + b * good
        want.add((u, s, good, used[u]))
    assert {tuple(r) for r in ledgers.admit(frame, 900).collect()} == want
    hosts = spark.createDataFrame([("h", i, t) for i, t in enumerate([0.0, 0.1, 0.2, 0.3, 2.3, 2.4])], "host string, seq long, at double")
    assert [r.allowed for r in ledgers.token_bucket(hosts, 1.0, 2.0).orderBy("seq").collect()] == [True, True, False, False, True, True]
    items = spark.createDataFrame([(1, i, k, n) for i, (k, n) in enumerate([(1, 4), (2, 4), (1, 4), (3, 4), (2, 4), (9, 99), (1, 4)])], "cache long, seq long, item long, size long")
    assert [(r.hit, r.evicted) for r in ledgers.simulate_cache(items, 10).orderBy("seq").collect()] == [(False, 0), (False, 0), (True, 0), (False, 1), (False, 1), (False, 0), (False, 1)]
    copies = spark.createDataFrame([(1, i, n, 100) for i, n in enumerate([3, 3, 3, 80, 11, 0])], "copy_id long, seq long, bytes long, total long")
    assert [r.percent for r in ledgers.copy_progress(copies).orderBy("seq").collect()] == [6, 89, 100]
    assert ledgers.admit(frame.limit(0), 1).count() == 0


def test_sequences(spark):
    ids = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (1, 3, 1)], "stream long, seq long, n long")
    assert [r.first_id for r in ledgers.allocate_ids(ids).orderBy("seq").collect()] == [1, 2, 7]
    flakes = ledgers.snowflake_ids(spark.range(5000).select(F.lit(3).alias("node"), F.lit(1000).alias("ms"), F.col("id").alias("request_id")))
    assert flakes.where("over").count() == 5000 - 4096 and flakes.where("request_id = 1").first().id == 1000 << 22 | 3 << 12 | 1
    files = spark.createDataFrame([(1, 0), (2, 65536), (3, 65537), (4, 131072)], "file_id long, file_size long")
    assert sorted(tuple(r) for r in ledgers.chunk_layout(files, 65536, 65536).collect()) == [(3, 0, 65536), (3, 65536, 1), (4, 0, 65536), (4, 65536, 65536)]


def test_percentiles(spark):
    frame = spark.createDataFrame([("a", True, i) for i in range(100)] + [("a", False, 10**6), ("b", True, 7)], "op string, ok boolean, latency_ns long")
    got = {r.op: r for r in ledgers.latency_report(frame, "op", {"p50": 0.5, "p99": 0.99, "p999": 0.999}, 2.0).collect()}
    rng = random.Random(5)
    values = [int(rng.lognormvariate(12, 3)) for _ in range(3000)]
    many = spark.createDataFrame([("x", True, v) for v in values], "op string, ok boolean, latency_ns long")
    r = ledgers.latency_report(many, "op", {"p0": 0.0, "p50": 0.5, "p999": 0.999, "p100": 1.0}, 1.0).first()
    values.sort()
    assert [r.p0, r.p50, r.p999, r.p100] == [values[ledgers.percentile_place(3000, p)] for p in (0.0, 0.5, 0.999, 1.0)]
    assert (got["a"].p50, got["a"].p99, got["a"].p999, got["a"].qps, got["b"].p99) == (49, 98, 98, 50.0, 7)


def test_registry_boundary(spark):
    seen = spark.createDataFrame([("a", 100, "x"), ("b", 70, "y"), ("c", 69, "z"), ("a", 50, "w")], "id string, at long, address string")
    assert {r.id: (r.alive, r.address) for r in ledgers.registry(seen, 100).collect()} == {"a": (True, "x"), "b": (False, "y")}


def test_replication(spark):
    feed = spark.createDataFrame([("/a", 1, "create", 10), ("/b", 2, "delete", 100 * 10**9), ("/c", 3, "create", 1), ("/d", 4, "delete", 500 * 10**9)], "path string, seq long, op string, ts_ns long")
    target = spark.createDataFrame([("/a", 5), ("/b", 3700), ("/d", 400)], "path string, mtime long")
    source = spark.createDataFrame([("/a", 9)], "path string, mtime long")
    got = {r.path: (r.status, r.mtime) for r in feeds.replicate(target, source, feed).collect()}
    assert got == {"/a": ("ok", 9), "/b": ("skipped_stale", 3700), "/c": ("error", None), "/d": ("ok", None)}


def test_locks(spark):
    rows = [(0, 0, "lock", "a", None), (1, 5, "lock", "b", None), (2, 6, "lock", "a", None), (3, 7, "lock", "a", "bad"), (4, 8, "lock", "b", "t2"), (5, 9, "unlock", "a", "t2"), (6, 9, "unlock", "b", "t4"), (7, 9, "unlock", "b", "t4"), (8, 10, "lock", "c", None), (9, 21, "lock", "d", None)]
    frame = spark.createDataFrame([("l", s, at, k, o, t, 10) for s, at, k, o, t in rows], "name string, seq long, at long, kind string, owner string, token string, ttl long")
    got = [(r.outcome, r.owner) for r in feeds.locks(frame).orderBy("seq").collect()]
    assert got == [("acquired", "a"), ("held", "a"), ("acquired", "a"), ("not owner", None), ("acquired", "b"), ("not owner", None), ("released", None), ("not found", None), ("acquired", "c"), ("acquired", "d")]


def test_records(tmp_path, spark):
    full = volumes.Needle(1, 2**64 - 1, b"data", b"n", b"m", b"{}", 2**39, "3d", 77, True)
    for version in (1, 2, 3):
        for n in (full, volumes.Needle(9, 5, b"x" * 100), volumes.Needle(1, 2)):
            record = volumes.encode(n, version)
            back, size = volumes.decode(record, version)
            assert len(record) % 8 == 0 and size == len(record)
            assert back == (n if version == 3 else volumes.Needle(**{**vars(n), "append_at_ns": 0}))
    broken = bytearray(volumes.encode(full))
    broken[25] ^= 1
    with pytest.raises(ValueError):
        volumes.decode(bytes(broken))
    size = codes.needle_disk_size(F.lit(4), F.lit(1), F.lit(1), F.lit(2), F.lit(True), F.lit(True), F.lit(3))
    assert one(spark, size) == len(volumes.encode(full))
    head = volumes.encode_head(3, 0b00101001, "5w", 2)
    assert volumes.decode_head(head) == {"version": 3, "placement": 0b00101001, "ttl": "5w", "revision": 2} and len(head) == 8


def test_volume_files(tmp_path, spark):
    rows = [(v, s, s * 3, v * 100 + s, b"d" * (s % 50)) for v in (1, 2) for s in range(60)]
    volumes.write_volume(spark.createDataFrame(rows, "vid long, seq long, cookie long, id long, data binary"), str(tmp_path))
    got = volumes.read_dat(spark, str(tmp_path)).collect()
    assert sorted((int(r.id), bytes(r.data), r.deleted) for r in got) == sorted((i, d, not d) for _, _, _, i, d in rows)
    spark.dataSource.register(volumes.NeedleSource)
    again = spark.read.format("needles").load(str(tmp_path)).collect()
    assert sorted((int(r.id), r.pos) for r in again) == sorted((int(r.id), r.pos) for r in got)
    index = volumes.read_index(spark, str(tmp_path)).collect()
    assert {(int(r.needle_key), r.offset) for r in index} == {(int(r.id), r.pos) for r in got}
    assert all((r.size == 0) == (int(r.needle_key) % 100 % 50 == 0) for r in index)
    assert sorted(r.vid for r in volumes.volume_ids(volumes.scan_folder(spark, str(tmp_path))).collect()) == [1, 2]
    with open(tmp_path / "1.idx", "ab") as f:
        f.write(b"torn")
    with open(tmp_path / "1.dat", "ab") as f:
        f.write(b"torn record that has no end....")
    assert volumes.read_index(spark, str(tmp_path)).count() == len(index) and volumes.read_dat(spark, str(tmp_path)).count() == len(got)


def test_odd_records(spark, tmp_path):
    """Heads without a body, wrong checksums, a body that is too short, pieces of a volume."""
    needle = volumes.Needle(7, 1, b"hello")
    good, bare = volumes.encode(needle), volumes.RECORD_HEAD.pack(8, 2, 0)
    wrong = bytearray(volumes.encode(volumes.Needle(9, 3, b"world")))
    wrong[20] ^= 1
    short = volumes.RECORD_HEAD.pack(10, 4, 3) + b"abc" + b"\0" * 5
    assert volumes.decode(bare) == (volumes.Needle(8, 2), 16)
    (tmp_path / "5.dat").write_bytes(volumes.encode_head(3) + good + bare + good)
    assert [(int(r.id), bytes(r.data), r.deleted) for r in volumes.read_dat(spark, str(tmp_path)).orderBy("pos").collect()] == [(1, b"hello", False), (2, b"", True), (1, b"hello", False)]
    (tmp_path / "5.dat").write_bytes(volumes.encode_head(3) + good + bytes(wrong) + short + bare + good)
    with pytest.raises(Exception, match="checksum"):
        volumes.read_dat(spark, str(tmp_path)).collect()
    spark.dataSource.register(volumes.NeedleSource)
    for read in (volumes.read_dat(spark, str(tmp_path), "mark"), spark.read.format("needles").option("corrupt", "mark").load(str(tmp_path))):
        got = [(int(r.id), r.error, r.deleted) for r in read.orderBy("pos").collect()]
        assert got == [(1, None, False), (3, "the checksum is wrong", False), (4, "the record is cut short", False), (2, None, True), (1, None, False)]


def test_a_volume_is_read_in_pieces(spark, tmp_path):
    rows = [(1, s, s, s, b"x" * (s % 97)) for s in range(1, 500)]
    volumes.write_volume(spark.createDataFrame(rows, "vid long, seq long, cookie long, id long, data binary"), str(tmp_path))
    pieces = volumes.splits(tmp_path / "1.dat", 1000)
    assert len(pieces) > 20 and pieces[0][0] == 8 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    spark.dataSource.register(volumes.NeedleSource)
    got = spark.read.format("needles").option("splitBytes", 1000).load(str(tmp_path))
    assert sorted((int(r.id), len(r.data)) for r in got.collect()) == [(s, s % 97) for s in range(1, 500)]
    (tmp_path / "1.idx").unlink()
    assert volumes.splits(tmp_path / "1.dat", 1000) == [(8, (tmp_path / "1.dat").stat().st_size)]


def test_many_rules_are_joined(spark, monkeypatch):
    """Beyond the bound of a broadcast list the answers are the same."""
    from quarry.plans import rewrite

    objects = spark.createDataFrame([(f"/b/{k}/x", k * 86400, {"t": str(k % 2)}) for k in range(12)], "path string, mtime_sec long, tags map<string, string>")
    rules = spark.createDataFrame([(0, "/b/1", 3, 0, "", "Enabled", "t", "1"), (1, "/b/", 0, 2, "COLD", "Enabled", None, None), (2, "/b/", 8, 0, "", "Enabled", "t", "0"), (3, "", 1, 0, "", "Disabled", None, None)], "rule_idx int, prefix string, expire_days int, transition_days int, storage_class string, status string, tag_key string, tag_value string")
    requests = spark.createDataFrame([(1, "https://a", "get"), (2, "https://b", "PUT"), (3, "x", "DELETE"), (4, "https://a", "PUT")], "request_id long, origin string, method string")
    sites = spark.createDataFrame([(0, ["https://A"], ["GET"]), (1, ["*"], ["DELETE", "get"]), (2, ["https://b", "https://a"], ["put"])], "rule_idx int, origins array<string>, methods array<string>")
    few = policies.lifecycle(objects, rules, 12 * 86400).collect(), policies.first_site_rule(requests, sites).collect()
    assert {r.path: r.action for r in few[0]}["/b/1/x"] == "delete" and {r.rule_idx for r in few[1]} == {0, 1, 2}
    monkeypatch.setattr(policies, "is_small", lambda _: False)
    many = policies.lifecycle(objects, rules, 12 * 86400).collect(), policies.first_site_rule(requests, sites).collect()
    for a, b in zip(few, many, strict=True):
        assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    monkeypatch.setattr(rewrite, "BROADCAST_ROWS", 1)
    with pytest.raises(ValueError, match="every row"):
        rewrite.with_list(requests, sites.unionByName(sites), "rules")


def test_upload_tally(spark):
    def put(row):
        if row["name"] == "b":
            raise OSError("full")

    got = feeds.upload(spark.createDataFrame([("a", 1), ("b", 2)], "name string, size long"), put).collect()
    assert [tuple(r) for r in sorted(got)] == [("a", 1, True, None), ("b", 2, False, "OSError: full")]


def test_erasure(spark, tmp_path):
    rng = random.Random(2)
    for k, m, lost in ((10, 3, (0, 5, 12)), (6, 3, (2, 7)), (4, 2, (1, 3)), (3, 0, ())):
        for n in (0, 1, 9, 1000):
            data = rng.randbytes(n)
            made = dict(enumerate(erasure.shards_of(data, k, m)))
            assert erasure.verify(made, k, m)
            left = {i: s for i, s in made.items() if i not in lost}
            assert erasure.reconstruct(left, k, m) == [made[i] for i in range(k + m)]
    with pytest.raises(ValueError):
        erasure.code_matrix(0, 1)
    with pytest.raises(ValueError):
        erasure.code_matrix(3, -1)
    with pytest.raises(ValueError):
        erasure.reconstruct({0: b"a", 1: b"bc"}, 2, 1)
    with pytest.raises(ValueError):
        erasure.reconstruct({0: b"a"}, 2, 1)
    # a published example of this code: five data shards, five of parity
    known = [bytes(x) for x in ([0, 1], [4, 5], [2, 3], [6, 7], [8, 9], [12, 13], [10, 11], [14, 15], [90, 91], [94, 95])]
    assert erasure.shards_of(b"".join(known[:5]), 5, 5) == known
    assert erasure.reconstruct({i: known[i] for i in (9, 8, 6, 3, 0)}, 5, 5) == known
    frame = spark.createDataFrame([(1, b"hello"), (2, b""), (3, b"z" * 77)], "id long, data binary")
    shards = erasure.encode(frame, "id", 4, 2)
    erasure.write_shards(shards, str(tmp_path / "ec"))
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "ec" / "manifest")).select("shard_idx", "objects", "bytes").collect()) == [(i, 3, 23) for i in range(6)]
    back = erasure.read_shards(spark, str(tmp_path / "ec")).where("shard_idx not in (0, 5)")
    assert {(r.id, bytes(r.data)) for r in erasure.decode(back, "id", 4, 2).collect()} == {(1, b"hello"), (2, b""), (3, b"z" * 77)}


def test_shards_are_made_of_few_bytes_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for bound in ("64m", "1g", "1024kb"):
            spark.conf.set(name, bound)
            rows = spark.range(0, 9000, 1, 1).select("id", F.expr("case when id = 7 then null when id = 8 then repeat('y', 3000000) else repeat(char(97 + id % 20), 1000 + id % 7) end").alias("data"))
            shards = erasure.encode(rows, "id", 4, 2)
            batches = rows.mapInArrow(lambda it: (b.select([0]).slice(0, 1) for b in it), "id long").count()
            assert batches >= 3  # one of 9,000 rows before
        for r in shards.where("id in (7, 8, 9, 8999)").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("shard_idx", "data"))).alias("s")).collect():
            data = {7: b"", 8: b"y" * 3_000_000}.get(r.id, bytes([97 + r.id % 20]) * (1000 + r.id % 7))
            assert [bytes(x.data) for x in r.s] == erasure.shards_of(data, 4, 2)
        back = erasure.decode(shards.where("shard_idx not in (0, 5)"), "id", 4, 2)
        assert back.join(rows.withColumnRenamed("data", "was"), "id").where("data = cast(coalesce(was, '') as binary)").count() == 9000
    finally:
        spark.conf.set(name, before)
    import pyarrow as pa

    batch = pa.record_batch({"data": pa.array([None, b"", *[b"x" * 400_000] * 9, b"y" * 5_000_000], pa.binary())})
    pieces = list(erasure._pieces([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(pieces).combine_chunks() == pa.Table.from_batches([batch]) and [p.num_rows for p in pieces] == [4, 2, 2, 2, 1, 1]
