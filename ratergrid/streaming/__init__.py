from ratergrid.streaming.annotation_log import (compact_annotation_log, read_annotation_log,
                                                run_annotation_log)
from ratergrid.streaming.ingest import run_ingest, stream_files, stream_progress

__all__ = ["compact_annotation_log", "read_annotation_log", "run_annotation_log", "run_ingest", "stream_files", "stream_progress"]
