"""Branches of one query share their shuffles, so that no source is read again for each."""

import json
import subprocess
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

FOLDER = "/root/testdata/sf0.001"
# A query, and one that reads the same sources with nothing to share.
PAIRS = {
    "partition_total": "join_two_keys",
    "entity_ratio_spread": "entity_ratio",
    "alt_score_ranked": "alt_score_v1",
    "tier_approval_rescaled": "alt_score_v1",
    "lift_by_signal": "rate_by_int_signal",
    "self_join_fill_preview": "value_counts",
}


@pytest.fixture(scope="module")
def reads(tmp_path_factory):
    names = sorted({*PAIRS, *PAIRS.values()})
    script = Path(__file__).parent / "count_reads.py"
    log = tmp_path_factory.mktemp("events")
    out = subprocess.run(
        [sys.executable, str(script), str(log), FOLDER, *names], capture_output=True, text=True, timeout=600, check=True
    )
    return json.loads(out.stdout.strip().splitlines()[-1])


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_sources_are_read_once(reads, name):
    assert 0 < reads[name] <= reads[PAIRS[name]]


def test_the_four_sources_take_one_scan_of_orders(reads):
    size = {t: pq.read_metadata(f"{FOLDER}/{t}.parquet").num_rows for t in ("orders", "events", "customer")}
    assert reads["alt_score_ranked"] <= size["orders"] + size["events"] + 2 * size["customer"]
