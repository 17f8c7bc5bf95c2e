"""Path functions (X1-X7, X11, X13) as Column expressions.

All of them compile to built-in string / array expressions, so they stay inside
whole-stage codegen and cost nothing extra at scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_path(path: ColumnOrName) -> Column:
    """Backslashes become slashes; NULL stays NULL."""
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def strip_trailing_slashes(path: ColumnOrName) -> Column:
    return F.regexp_replace(_c(path), "/+$", "")


def relative_path(full_path: ColumnOrName, mount_point: ColumnOrName) -> Column:
    """Path relative to the mount, with the fuzzy last-component rule.

    * both sides normalised, every trailing ``/`` stripped from the mount;
    * root or empty mount: the path unchanged;
    * exact prefix ``mount + '/'``: the rest;
    * else, when the mount has at least two components, the path at least as many, and
      all but the last mount component are equal: the last components ``a`` (mount) and
      ``b`` (path) match when ``(a != '' and b != '' and a in b) or (b in a)`` (an empty
      path component matches); the result is the components after the mount;
    * else the (normalised) path unchanged.
    """
    p = normalize_path(full_path)
    m = strip_trailing_slashes(normalize_path(mount_point))
    with_slash = F.concat(m, F.lit("/"))
    pf = F.split(p, "/", -1)
    pm = F.split(m, "/", -1)
    n_m = F.size(pm)
    n_f = F.size(pf)
    same_parent = F.slice(pf, 1, n_m - 1) == F.slice(pm, 1, n_m - 1)
    a = F.try_element_at(pm, F.lit(-1))
    b = F.try_element_at(pf, n_m)
    near = ((a != "") & (b != "") & F.contains(b, a)) | F.contains(a, b)
    fuzzy = (n_m >= 2) & (n_f >= n_m) & same_parent & near
    rest = F.array_join(F.slice(pf, n_m + 1, F.greatest(n_f - n_m, F.lit(0))), "/")
    return (
        F.when(p.isNull() | m.isNull(), F.lit(None).cast("string"))
        .when(m == "", p)
        .when(F.startswith(p, with_slash), F.substring(p, F.length(with_slash) + 1, 1 << 30))
        .when(fuzzy, rest)
        .otherwise(p)
    )


def platform_path(rel_path: ColumnOrName, mount_point: ColumnOrName, system: str | None = None) -> Column:
    """Join mount and relative path.

    One trailing ``/`` is dropped from the mount and one leading ``/`` from the relative
    path; then the join rule of ``os.path.join``: a relative part still beginning with
    ``/`` wins, an empty mount gives the relative part, a mount ending with ``/`` is
    concatenated directly, otherwise a ``/`` is put between. ``system='Windows'`` turns
    every ``/`` into ``\\``.
    """
    r = normalize_path(rel_path)
    m = normalize_path(mount_point)
    m = F.regexp_replace(m, "/$", "")
    r = F.regexp_replace(r, "^/", "")
    joined = (
        F.when(F.startswith(r, F.lit("/")), r)
        .when(m == "", r)
        .when(F.endswith(m, F.lit("/")), F.concat(m, r))
        .otherwise(F.concat(m, F.lit("/"), r))
    )
    if system == "Windows":
        joined = F.replace(joined, F.lit("/"), F.lit("\\"))
    return joined


# Mount-point patterns per operating system.
MOUNT_PATTERNS = {
    "Darwin": r"^/Volumes/([^/]+)",
    "Linux": r"^/media/([^/]+)/([^/]+)",
    "Windows": r"^([A-Z]:)",
}


def mount_point_pattern(system: str | None) -> str:
    """The mount regex of an OS; unknown systems use the Linux pattern."""
    return MOUNT_PATTERNS.get(system or "", MOUNT_PATTERNS["Linux"])


def extract_mount_point(path: ColumnOrName, system: str | Column | None) -> Column:
    """Mount part of a path for an OS; unknown OS gives NULL even when a pattern matches.

    ``system`` may be a literal or a column (one OS per row).
    """
    p = normalize_path(path)
    sys_col = F.lit(system) if not isinstance(system, Column) else system
    out = None
    for name, pat in MOUNT_PATTERNS.items():
        branch = F.nullif(F.regexp_extract(p, pat, 0), F.lit(""))  # the whole match is the mount
        out = F.when(sys_col == name, branch) if out is None else out.when(sys_col == name, branch)
    return out.otherwise(F.lit(None).cast("string"))


def basename(path: ColumnOrName) -> Column:
    """Text after the last ``/`` (``''`` for a path ending with ``/``)."""
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def dirname(path: ColumnOrName) -> Column:
    """Text before the last ``/`` with trailing slashes of the head removed (``os.path.dirname``)."""
    p = _c(path)
    head = F.regexp_extract(p, r"^(.*/)?[^/]*$", 1)
    stripped = F.regexp_replace(head, "/+$", "")
    # a head made only of slashes stays as it is (root)
    return F.when(F.regexp_like(head, F.lit("^/+$")), head).otherwise(stripped)


def device_label(mount: ColumnOrName) -> Column:
    """Label of a mount = its basename, or ``'Root'`` when that is empty."""
    return F.coalesce(F.nullif(basename(mount), F.lit("")), F.lit("Root"))


def extension(path: ColumnOrName) -> Column:
    """``os.path.splitext(path)[1].lower()``: from the last dot of the basename,
    leading dots of the basename ignored."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def is_absolute(path: ColumnOrName) -> Column:
    """X11: ``os.path.isabs`` on POSIX."""
    return F.startswith(_c(path), F.lit("/"))


def rewrite_to_relative(path: ColumnOrName, mount_point: ColumnOrName) -> Column:
    """Absolute paths become mount-relative (X2); relative paths stay."""
    return F.when(is_absolute(path), relative_path(path, mount_point)).otherwise(_c(path))


def rewrite_status(path: ColumnOrName, mount_point: ColumnOrName) -> Column:
    """X13 status per row: ``already relative``, ``convertible`` or ``error`` (a missing
    path, or an absolute path without a mount to cut)."""
    return (
        F.when(_c(path).isNull(), F.lit("error"))
        .when(~is_absolute(path), F.lit("already relative"))
        .when(_c(mount_point).isNull(), F.lit("error"))
        .otherwise(F.lit("convertible"))
    )


def join_path(base: ColumnOrName, rel: ColumnOrName) -> Column:
    """``os.path.join(base, rel)`` on POSIX: an absolute ``rel`` wins, an empty base or one
    ending with ``/`` is concatenated directly, otherwise a ``/`` goes between."""
    b, r = _c(base), _c(rel)
    return (F.when(F.startswith(r, F.lit("/")), r)
            .when((b == "") | F.endswith(b, F.lit("/")), F.concat(b, r))
            .otherwise(F.concat(b, F.lit("/"), r)))


def system_id_of(os_name: ColumnOrName, host: ColumnOrName, lower: bool = True) -> Column:
    """``lower(os)-host`` (configuration form) or ``OS-host`` (sync form)."""
    o = F.lower(_c(os_name)) if lower else _c(os_name)
    return F.concat_ws("-", o, _c(host))
