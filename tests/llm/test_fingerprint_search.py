"""The search of fingerprints within a radius: what it sends, that it loses no pair, and op5's counts."""

from collections import Counter

import pytest

from orderflow.llm import fingerprints
from orderflow.llm.queries import QUERIES
from orderflow.session import scratch_path


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def frame(spark, values):
    return spark.createDataFrame([(signed(v & (2 ** 64 - 1)), signed(v >> 64)) for v in values], "a long, b long")


def test_a_stored_fingerprint_is_sent_once_per_block(spark):
    """28 rows each, one per pair of eight blocks, made the shuffle of op5 grow beyond its texts."""
    stored = frame(spark, range(1, 51))
    assert fingerprints.block_tables(stored, 6).count() == 4 * 50


def test_an_exploded_side_is_not_broadcast(spark):
    """A side's estimated size leaves out explode: it was broadcast at many times the threshold."""
    stored = spark.range(50).selectExpr("id AS a", "-id AS b")
    plan = fingerprints.within_radius(stored, stored)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("radius", range(14))
def test_no_pair_is_lost_wherever_bits_differ(spark, radius):
    """Each stored value has ``radius`` bits, or one more, set at the places least kind to the blocks."""
    blocks = fingerprints._blocks(radius)
    values = [0, 1 << 127]
    for most in (radius, radius + 1):
        for turn in range(len(blocks)):
            order = [*blocks[turn:], *blocks[:turn]]
            for step in (1, 5):  # one bit over what each block may differ in, from its lowest bit on
                bits = [lo + step * k for lo, hi, may in order for k in range(may + 1) if lo + step * k < hi][:most]
                bits += [b for b in range(128) if b not in bits][:most - len(bits)]
                values.append(sum(1 << b for b in bits))
    got = fingerprints.within_radius(frame(spark, [0]), frame(spark, values), radius).collect()
    full = lambda a, b: (a & (2 ** 64 - 1)) | (b & (2 ** 64 - 1)) << 64
    want = {(v, v.bit_count()) for v in values if v.bit_count() <= radius}
    assert Counter((full(x.a, x.b), x.bits) for x in got) == Counter(want)


def test_op5_counts_documents_near_each_query(spark):
    text = " ".join(f"word{k}" for k in range(400))
    near = text.replace("word7 ", "other ")
    rows = [(i, (text, near, f"text {i} of its own words w{i} v{i}", "", None)[i % 5]) for i in range(60)]
    rows += [(20, near), (20, near), (None, text), (None, "without an id"), (-20, text)]
    sf = scratch_path(spark, "op5-sf")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    value = [int.from_bytes(fingerprints.fingerprint(t or ""), "little") for _, t in rows]
    want = Counter((i, v.to_bytes(16, "little").hex(), sum((v ^ w).bit_count() <= fingerprints.RADIUS for w in value)
                    if i is not None and i % 20 == 0 else None) for (i, _), v in zip(rows, value, strict=True))
    found = QUERIES["op5_fingerprints"](spark, sf)
    assert Counter((r.doc_id, r.fingerprint, r.n_near) for r in found.collect()) == want
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                             "near_next", "n_near"]
