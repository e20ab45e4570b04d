"""Tables of the store, fixed values, and validity of keys.

Hashes are BINARY in stored tables. Operators only compare them, so they work on hex text as well, which the
projections use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the store's formats and limits.
PAGE_SIZE = 4096
RECORD_SIZE = 4133  # payload and 37 bytes of record header
PACK_HEADER = 20
PACK_LIMIT = 1 << 30
CHAIN_CAP = 4096
QUERY_DEFAULT, QUERY_CAP = 512, 4096
HAS_PAGES_CAP = 4096
MESSAGE_PAGES = 256
LOG_MIN, LOG_MAX = 56, 16 << 20
KEY_MIN, KEY_MAX, VALUE_MAX = 1, 512, 16 << 20
EXPERIMENT_MIN, EXPERIMENT_MAX = 1, 128
#: Node states as stored.
STATUS = {"FRONTIER": 0, "EXPANDED": 1, "TERMINAL": 2, "PRUNED": 3}
PRUNED = STATUS["PRUNED"]
SCHEMA_VERSION = 2

NODES = "experiment_id string, node_id bigint, parent_node_id bigint, depth int, snapshot_ref binary, input_log_id binary, status tinyint, score double, visit_count bigint, icount bigint, virtual_ns bigint, created_at bigint, updated_at bigint, last_visited_at bigint, attrs binary"
INPUT_LOGS = "log_id binary, inner_format_version bigint, content binary, created_at bigint"
KV = "key binary, value binary, generation bigint, updated_at bigint"
PINS = "snapshot_ref binary, note string, created_at bigint"
TOMBSTONES = "experiment_id string, node_id bigint, created_at bigint"
GC_STATE = "cycles_total bigint, last_fence_counter bigint, last_finished_at bigint, last_freed_bytes bigint"
PAGES = "page_hash binary, payload binary, pack_id int, offset bigint"
MANIFESTS = "snapshot_ref binary, version int, is_delta boolean, parent_ref binary, guest_ram_bytes bigint, entry_count bigint, device_blob struct<format: bigint, zstd: boolean, bytes: binary, raw_len: bigint>, container binary"
ENTRIES = "snapshot_ref binary, page_index bigint, page_hash binary"
META = "schema_version int, store_uuid string, logical_counter bigint"
TABLES = {"nodes": NODES, "input_logs": INPUT_LOGS, "kv_metadata": KV, "pins": PINS, "tombstones": TOMBSTONES, "gc_state": GC_STATE, "pages": PAGES, "manifests": MANIFESTS, "manifest_entries": ENTRIES, "meta": META}
NODE_COLUMNS = [x.split()[0] for x in NODES.split(", ")]


def valid_hash(c: Column) -> Column:
    return F.octet_length(c) == 32


def valid_experiment(c: Column) -> Column:
    return F.octet_length(c).between(EXPERIMENT_MIN, EXPERIMENT_MAX)


def valid_key(c: Column) -> Column:
    return F.octet_length(c).between(KEY_MIN, KEY_MAX)


def valid_value(c: Column) -> Column:
    return F.octet_length(c) <= VALUE_MAX


def valid_log(content: Column) -> Column:
    return F.octet_length(content).between(LOG_MIN, LOG_MAX)


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """Null unless the text is 64 hex digits, in either case."""
    return F.when(c.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(c))


def status_name(c: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in STATUS]), c.cast("int"))


def status_code(name: Column) -> Column:
    """An unknown or missing name means FRONTIER."""
    out = F.lit(STATUS["FRONTIER"])
    for k, v in STATUS.items():
        out = F.when(F.upper(name) == k, F.lit(v)).otherwise(out)
    return out.cast("tinyint")


def _big(bits: int) -> Column:
    return F.lit(str(2**bits)).cast("decimal(20,0)")


def signed(c: Column) -> Column:
    """An unsigned 64-bit number (DECIMAL(20,0)) as the stored BIGINT with the same bits."""
    return F.when(c >= _big(63), c - _big(64)).otherwise(c).cast("bigint")


def unsigned(c: Column) -> Column:
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + _big(64)).otherwise(d).cast("decimal(20,0)")


def strict(ok: Column, value: Column, message: str) -> Column:
    """value where ok, else an error that ends the query."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))
