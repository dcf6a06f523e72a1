import math
import zlib

import xxhash

from lodestone.llm.sharding import HashTree, assign_shards, number_slots


def test_tree():
    tree = HashTree.regular(11, racks=2, per_rack=3)
    assert [[[s for s, _ in rack] for rack in region] for region in tree.regions] == [[[0, 1, 2], [3, 4, 5]], [[6, 7, 8], [9, 10]]]
    assert tree.grown().regions[-1] == (((11, 1.0),),)


def placed(spark, tree, n=4000):
    return {r.k: r.shard for r in assign_shards(spark.range(n).withColumnRenamed("id", "k"), "k", tree).collect()}


def test_growth_only_moves_into_the_new_shard(spark):
    tree, before = HashTree.regular(24), None
    for _ in range(3):
        now = placed(spark, tree)
        if before is not None:
            new = max(now.values())
            moved = {k for k in now if now[k] != before[k]}
            assert all(now[k] == new for k in moved) and len(moved) == sum(s == new for s in now.values()) > 80
        before, tree = now, tree.grown()


def test_weights(spark):
    tree = HashTree.regular(12, racks=2, per_rack=3)
    before, after = placed(spark, tree, 20000), placed(spark, tree.reweighted(4, 3.0), 20000)
    share = sum(s == 4 for s in after.values()) / 20000
    assert abs(share - 3 / 14) < 0.02 and all(abs(sum(s == k for s in before.values()) / 20000 - 1 / 12) < 0.012 for k in range(12))
    # rows only move into the region, rack and shard whose weight grew
    region = lambda s: s // 6
    assert all(region(after[k]) == 0 for k in after if region(after[k]) != region(before[k]))
    assert sum(s == 4 for s in placed(spark, tree.reweighted(4, 0.0)).values()) == 0


def test_odd_rows(odd):
    rows = number_slots(assign_shards(odd, "doc_id", HashTree.regular(4)), "doc_id", order=["text"]).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1 and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert number_slots(assign_shards(odd.limit(0), "doc_id", HashTree.regular(4)), "doc_id").count() == 0


def test_query(spark, odd, tmp_path):
    from lodestone.llm.sharding import op5_hash_tree_shards

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op5_hash_tree_shards(spark, str(tmp_path)).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    assert all(0 <= r.shard < 24 and (r.grown_shard == r.shard or r.grown_shard == 24) for r in rows)


def hashed(*parts):
    """A chain of XXH64: strings by their bytes, numbers of 4 or 8 bytes; nulls are passed over."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p, h)
    return h


def descended(tree, doc):
    """The shard of a key, by draws in plain loops."""
    number = lambda i: i.to_bytes(4, "little")
    key = None if doc is None else doc.to_bytes(8, "little", signed=True)

    def least(level, path, weights):
        draws = [-math.log(((hashed(level, *map(number, path), number(i), key) >> 12) + 1) / 2**52) / w if w else math.inf for i, w in enumerate(weights)]
        return draws.index(min(draws))

    total = lambda node: node[1] if isinstance(node[0], int) else sum(map(total, node))
    region = least("region", [], [total(r) for r in tree.regions])
    rack = least("rack", [region], [total(r) for r in tree.regions[region]])
    return tree.regions[region][rack][least("shard", [region, rack], [w for _, w in tree.regions[region][rack]])][0]


def test_query_against_brute_force(spark, odd, tmp_path):
    from lodestone.llm.sharding import op5_hash_tree_shards

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    tree, uneven = HashTree.regular(24), HashTree.regular(24).reweighted(3, 5.0).reweighted(20, 0.0)
    rows = op5_hash_tree_shards(spark, str(tmp_path)).collect()
    assert all((r.shard, r.grown_shard) == (descended(tree, r.doc_id), descended(tree.grown(), r.doc_id)) for r in rows)
    assert all(r.shard == descended(uneven, r.doc_id) for r in assign_shards(odd, "doc_id", uneven).select("doc_id", "shard").collect())
    place = lambda r: (hashed("slot", None if r.doc_id is None else r.doc_id.to_bytes(8, "little", signed=True)) >> 52, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.slot)  # noqa: E731  rows alike in all may change places
    for shard in {r.shard for r in rows}:
        assert [r.slot for r in sorted((r for r in rows if r.shard == shard), key=place)] == list(range(sum(r.shard == shard for r in rows)))
