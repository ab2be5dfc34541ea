"""Readers and writers."""

from growthlens.sources.files import corrupt_rows, file_headers, load_folder, read_table, read_tables, with_name_part
from growthlens.sources.sheets import read_sheet
from growthlens.sources.sinks import run_report, write_table

__all__ = ["corrupt_rows", "file_headers", "load_folder", "read_sheet", "read_table", "read_tables", "run_report", "with_name_part", "write_table"]
