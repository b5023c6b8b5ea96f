from ratergrid.sources.guards import min_rows_guard, refuse_repeats, require_columns
from ratergrid.sources.keyed import append_keyed, read_keyed
from ratergrid.sources.readers import (evenly_spaced_chunks, scan_csv, scan_done_keys,
                                       scan_parquet, scan_parquet_parts)
from ratergrid.sources.split_csv import scan_csv_split
from ratergrid.sources.writers import (append_annotations, convert_parquet_to_csv, load_existing,
                                       sink_csv, sink_parquet_typed)

__all__ = [
    "append_annotations", "append_keyed", "convert_parquet_to_csv", "evenly_spaced_chunks", "load_existing",
    "min_rows_guard", "read_keyed", "refuse_repeats", "require_columns", "scan_csv", "scan_csv_split", "scan_done_keys", "scan_parquet",
    "scan_parquet_parts", "sink_csv", "sink_parquet_typed",
]
