"""Which loader reads a file: by extension and content type, the first rule that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of source and plain text files. Fixed values.
SOURCE_EXTENSIONS = (
    "go", "py", "java", "sh", "bat", "ps1", "cmd", "js", "ts", "css", "cpp", "hpp", "h", "c", "cs", "sql", "log", "ini", "pl", "pm", "r", "dart",
    "dockerfile", "env", "php", "hs", "hsc", "lua", "nginxconf", "conf", "m", "mm", "plsql", "perl", "rb", "rs", "db2", "scala", "bash", "swift", "vue",
    "svelte", "yml", "yaml", "eml", "ex", "exs", "erl", "tsx", "jsx", "lhs",
)
#: Extensions of binary formats, whose content type Markdown can't override. Fixed values.
BINARY_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "epub")
_OFFICE = "application/vnd.openxmlformats-officedocument."
#: (loader, extensions, content types), in order of precedence. Fixed values.
RULES = (
    ("pdf", ("pdf",), ("application/pdf",)),
    ("csv", ("csv",), ("text/csv",)),
    ("rst", ("rst",), ()),
    ("xml", ("xml",), ("application/xml", "text/xml", "application/xhtml+xml")),
    ("slides", ("ppt", "pptx"), ("application/vnd.ms-powerpoint", _OFFICE + "presentationml.presentation")),
    ("markdown", ("md",), ("text/markdown", "text/x-markdown", "application/markdown", "application/x-markdown")),
    ("epub", ("epub",), ("application/epub+zip",)),
    ("word", ("doc", "docx"), ("application/msword", _OFFICE + "wordprocessingml.document")),
    ("sheet", ("xls", "xlsx"), ("application/vnd.ms-excel", _OFFICE + "spreadsheetml.sheet")),
    ("json", ("json",), ("application/json",)),
)


def extension(filename: Column) -> Column:
    """What follows the last dot, in lower case; the whole name if there is none."""
    return F.lower(F.substring_index(filename, ".", -1))


def loader(filename: Column, content_type: Column) -> Column:
    """The loader's name; 'text' for source files and ``text/`` types, 'unknown' for the rest (read as text). Nulls count as ''."""
    ext, mime = extension(F.coalesce(filename, F.lit(""))), F.coalesce(content_type, F.lit(""))
    choice: Column | None = None
    for name, extensions, types in RULES:
        by_type = mime.isin(*types) if types else F.lit(False)
        if name == "markdown":
            by_type = by_type & ~ext.isin(*BINARY_EXTENSIONS)
        fits = ext.isin(*extensions) | by_type
        choice = F.when(fits, name) if choice is None else choice.when(fits, name)
    return choice.when(ext.isin(*SOURCE_EXTENSIONS) | mime.contains("text/"), "text").otherwise("unknown")


def known(name: Column) -> Column:
    return name != "unknown"
