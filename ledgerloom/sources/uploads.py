"""Checks of uploaded files before they are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upload_verdict(name: Column, mime: Column, size: Column, head: Column, encrypted: Column, pages: Column, most_bytes: int, most_pages: int | None = None) -> Column:
    """The first reason to refuse a PDF, or null: its name's extension, a declared type that isn't PDF, its size, a beginning without %PDF-d.d in the first 1,024 characters, encryption, no
    pages, or more than most_pages."""
    kind = F.lower(F.trim(F.regexp_extract(F.coalesce(mime, F.lit("")), r"^([^;]*)", 1)))
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\]", "")
    verdict = (
        F.when(~F.lower(base).endswith(".pdf") | ~kind.isin("", "application/pdf", "application/x-pdf"), "UNSUPPORTED_FILE_TYPE")
        .when(size > most_bytes, "UPLOAD_TOO_LARGE")
        .when((size == 0) | ~F.left(head, F.lit(1024)).rlike(r"%PDF-\d\.\d"), "UNSUPPORTED_FILE_TYPE")
        .when(encrypted, "ENCRYPTED_PDF")
        .when(pages < 1, "CORRUPT_PDF")
    )
    return verdict.when(pages > most_pages, "PDF_PAGE_LIMIT_EXCEEDED") if most_pages is not None else verdict
