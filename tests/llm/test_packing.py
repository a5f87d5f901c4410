import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import packing
from pagewright.llm.packing import cut, plan_packing


@pytest.mark.parametrize("seed", range(25))
def test_plan_uses_every_length_once(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 64, 1024])
    lengths = Counter(r.randint(1, capacity) for _ in range(r.choice([0, 1, 20, 3000])))
    plan = plan_packing(lengths, capacity)
    used = Counter()
    for pattern, n in plan:
        assert n > 0 and 0 < sum(pattern) <= capacity
        for x in pattern:
            used[x] += n
    assert used == +lengths
    # Never worse than first fit decreasing, never better than the sum allows.
    bins = []
    for x in sorted(lengths.elements(), reverse=True):
        at = next((i for i, b in enumerate(bins) if b + x <= capacity), None)
        if at is None:
            bins.append(x)
        else:
            bins[at] += x
    total = sum(n for _, n in plan)
    assert -(-sum(k * v for k, v in lengths.items()) // capacity) <= total <= len(bins) + 1


def test_exact_complements_come_first():
    assert sorted(plan_packing({10: 2, 6: 3, 4: 3, 5: 2, 3: 1, 1: 1}, 10)) == sorted(
        [((10,), 2), ((6, 4), 3), ((5, 5), 1), ((3, 1), 1)]
    )
    assert plan_packing({5: 1, 3: 1, 2: 1}, 10) == [((5, 3, 2), 1)]


def test_exact_triples_fill_gaps():
    # Best fit alone would put 200, 100 and 20 beside 700.
    assert plan_packing({700: 1, 200: 1, 100: 1, 24: 1, 20: 1}, 1024) == [((700, 200, 100, 24), 1), ((20,), 1)]
    assert plan_packing({700: 3, 200: 3, 100: 3, 24: 3}, 1024) == [((700, 200, 100, 24), 3)]


def test_triples_reach_the_plan_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths = {r["length"]: r["count"] for r in packing.token_pieces(docs).groupBy("length").count().collect()}
    taken, place = [], packing._Filling.place

    def watched(state, room, parts):
        taken.append((room, parts))
        place(state, room, parts)

    packing._Filling.place = watched
    try:
        plan = plan_packing(lengths, 1024)
    finally:
        packing._Filling.place = place
    assert any(len(parts) == 3 and sum(parts) == room for room, parts in taken)
    assert sum(n for _, n in plan) <= 193


def test_too_long_a_length_is_an_error():
    with pytest.raises(ValueError):
        plan_packing({11: 1}, 10)


def test_cut():
    assert cut(1, 4) == [(0, 1)]
    assert cut(8, 4) == [(0, 4), (4, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_documents(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(cut(len(ids), 64)):
            want[r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    rows = packing.pack_documents(odd, capacity=64, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in rows) // 64) + 1


def test_no_documents(none):
    assert packing.pack_documents(none).count() == 0


def test_written_tables_can_be_dropped(spark, none):
    from pagewright.llm import common

    kept = common.WRITTEN[:]
    common.WRITTEN.clear()
    path = common.write_table(none, "x")
    assert spark.read.parquet(path).count() == 0
    common.drop_all(spark)
    assert not common.WRITTEN
    common.WRITTEN.extend(kept)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
