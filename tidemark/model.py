"""Options, limits, errors and the mutation schema."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MAX_KEY_BYTES = 1 << 20
MAX_VALUE_BYTES = 16 << 20
BLOCK_BYTES = 4096

#: One version of a key.  A tombstone has an empty value; an empty value without one is live.
MUTATION = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("sequence", T.LongType(), False),
    T.StructField("tombstone", T.BooleanType(), False),
    T.StructField("value", T.StringType(), False),
])


class InvalidArgument(ValueError):
    """A call that is refused before it changes anything."""


class CorruptStore(RuntimeError):
    """A table, log or manifest that must not be read on."""


@dataclass(frozen=True)
class Options:
    memtable_bytes: int = 64 * 1024
    bloom_bits_per_key: int = 10
    compaction_trigger: int = 4
    sync_writes: bool = True

    def __post_init__(self):
        if self.memtable_bytes < 1 or self.bloom_bits_per_key < 1 or self.compaction_trigger < 2:
            raise InvalidArgument("memtable_bytes and bloom_bits_per_key are 1 at least, compaction_trigger is 2 at least")


def check_range(begin: str | bytes, end: str | bytes) -> None:
    """A scan's arguments: bytes of end must not sort before those of begin, so an empty end is open only after an empty begin."""
    raw = [x.encode() if isinstance(x, str) else x for x in (begin, end)]
    if raw[1] < raw[0]:
        raise InvalidArgument("scan end sorts before begin")


def check_key(key: str | bytes) -> None:
    size = len(key.encode() if isinstance(key, str) else key)
    if not 1 <= size <= MAX_KEY_BYTES:
        raise InvalidArgument(f"a key has 1 to {MAX_KEY_BYTES} bytes, not {size}")


def check_value(value: str | bytes) -> None:
    if len(value.encode() if isinstance(value, str) else value) > MAX_VALUE_BYTES:
        raise InvalidArgument(f"a value has at most {MAX_VALUE_BYTES} bytes")
