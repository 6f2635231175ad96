import gc
import re
from pathlib import Path

import pytest

from quillwork.plans.materialize import release

SMAPS = Path("/proc/self/smaps_rollup")


def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", SMAPS.read_text()))) / 1024


@pytest.mark.skipif(not SMAPS.exists(), reason="memory can't be read here")
def test_release_gives_freed_memory_back(spark):
    release(spark)
    before = held()
    # Blocks below the size that is mapped on its own, with some between them that stay.
    blocks = [bytearray(50_000) for _ in range(4_000)]
    stay = blocks[::100]
    del blocks
    gc.collect()
    kept = held()
    release(spark)
    assert stay and kept > before + 100 and held() < before + 20


def test_jvm_is_trimmed(spark):
    from quillwork.plans.materialize import trim

    assert trim(spark) is True
