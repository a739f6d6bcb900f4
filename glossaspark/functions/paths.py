"""Column expressions over paths and addresses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domains import IGNORED_DIRECTORIES, SUFFIXES

#: Names that Windows reserves, and characters it refuses.
RESERVED = ("aux", "con", "nul", "prn", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
REFUSED = r'[<>:"\\|?*]'


def suffix(path: Column) -> Column:
    """Last suffix of the file name in lower case; a leading dot is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*[^./])\z", 1))


def _looked_up(key: Column, values: dict[str, str | None]) -> Column:
    literals = F.create_map(*[F.lit(x) for x in chain.from_iterable((k, v) for k, v in values.items() if v)])
    return F.try_element_at(literals, key)


def file_kind(path: Column) -> Column:
    return _looked_up(suffix(path), {k: v[0] for k, v in SUFFIXES.items()})


def engine_hint(path: Column) -> Column:
    return _looked_up(suffix(path), {k: v[1] for k, v in SUFFIXES.items()})


def ignored(path: Column, directories: tuple[str, ...] = IGNORED_DIRECTORIES) -> Column:
    """Any part of the path is an ignored directory."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in directories]))


def safe_template(path: Column) -> Column:
    """Relative, no empty, ``.`` or ``..`` part, no colon or backslash, a script."""
    parts = F.split(path, "/", -1)
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | p.contains(":") | p.contains("\\"))
    return ~bad & path.endswith(".rpy")


def safe_archive_entry(path: Column) -> Column:
    """Relative path of at most 4096 bytes with forward slashes and no controls. Unicode
    normal form is a check of its own: see :func:`glossaspark.functions.unicode.nfc`."""
    bad = F.exists(F.split(path, "/", -1), lambda p: p.isin("", ".", "..") | p.contains(":") | p.rlike(r"[\x00-\x1f]"))
    return (F.octet_length(path) <= 4096) & (F.length(path) > 0) & ~path.contains("\\") & ~path.startswith("/") & ~bad


def safe_output(path: Column) -> Column:
    """An archive entry that can be written below ``game`` on Windows."""
    bad = F.exists(
        F.split(path, "/", -1),
        lambda p: p.rlike("[ .]$") | p.rlike(REFUSED) | F.lower(F.split(p, r"\.", 2)[0]).isin(*RESERVED),
    )
    return safe_archive_entry(path) & (F.lower(F.split(path, "/", -1)[0]) != "game") & ~bad


def contains_path(a: Column, b: Column) -> Column:
    """The paths are equal or one lies below the other."""
    return (a == b) | b.startswith(F.concat(a, F.lit("/"))) | a.startswith(F.concat(b, F.lit("/")))


def valid_endpoint(url: Column) -> Column:
    """HTTPS (HTTP on this machine only), no user, query or fragment, ends in
    ``/chat/completions``."""
    scheme, host = F.regexp_extract(url, r"^(https?)://", 1), F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1)
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    local = F.lower(host).isin("localhost", "[::1]") | host.rlike(r"^127(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\z")
    port = F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:@]*):([^/?#]*)", 1)
    good_port = (port == "") | (port.rlike(r"^[0-9]{1,9}\z") & (port.try_cast("int") <= 65535))
    clean = good_port & ~url.rlike(r"[\x00-\x1f]|^\s|\s\z") & ~url.rlike(r"^https?://[^/?#]*@") & ~url.rlike(r"[?#].")
    return F.coalesce(
        clean & (scheme != "") & (host != "") & F.rtrim(path, F.lit("/")).endswith("/chat/completions") & ((scheme == "https") | local),
        F.lit(False),
    )


def suggested_output(path: Column, tail: str = "-translated") -> Column:
    """Sibling of a project folder."""
    return F.concat(F.regexp_replace(path, r"[/\\]+\z", ""), F.lit(tail))
