"""URL predicates, size gates and attachment names as Column expressions."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import SPACE, blank_to_null, strip

SIZE_LIMIT = 26_214_400

# Extension of a media type that no header names.
DEFAULT_EXTENSIONS = {"image": ".jpg", "video": ".mp4", "voice": ".wav"}

# scheme, user-info, host, port of an absolute URL with an authority.
_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#]*)@)?(\[[^\]/?#@]*\]|[^:/?#@\[\]]*)(?::([^/?#@]*))?(?:[/?#].*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _AUTHORITY, group)


def host_of(col: Column) -> Column:
    return F.lower(_part(strip(col), 3))


def is_web_url(col: Column) -> Column:
    """http or https with a host."""
    url = strip(col)
    scheme = F.lower(_part(url, 1))
    return F.coalesce(scheme.isin("http", "https") & (_part(url, 3) != ""), F.lit(False))


def attachment_url_error(col: Column) -> Column:
    """First rule a strict attachment URL breaks, or null: blank, space, scheme, userinfo, port."""
    url = strip(F.coalesce(col, F.lit("")))
    port = _part(url, 4)
    return (
        F.when(url == "", "blank")
        .when(url.rlike(f"[{SPACE}\\x00-\\x1f]"), "space")
        .when((F.lower(_part(url, 1)) != "https") | (_part(url, 3) == ""), "scheme")
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*@"), "userinfo")
        .when(
            (port != "") & (~port.rlike(r"^\d+$") | (port.try_cast("decimal(38,0)") > 65535)),
            "port",
        )
    )


def is_host_family(col: Column, host: str) -> Column:
    """The host itself or one of its sub-domains."""
    name = host_of(col)
    return F.coalesce((name == host) | name.endswith("." + host), F.lit(False))


def size_gate(response: Column, probe: Column, actual: Column, limit: int = SIZE_LIMIT) -> Column:
    """struct(declared, source, error): declared size prefers the response over the probe.

    Sizes are whole numbers; negative ones count as absent. Checks run in the order in which
    the numbers become known: probe, response, received bytes, empty.
    """
    known_response = F.when(response >= 0, response)
    known_probe = F.when(probe >= 0, probe)
    return F.struct(
        F.coalesce(known_response, known_probe).alias("declared"),
        F.when(known_response.isNotNull(), "get-content-length")
        .when(known_probe.isNotNull(), "head-content-length")
        .otherwise("stream")
        .alias("source"),
        F.when(known_probe > limit, "probe_too_large")
        .when(known_response > limit, "response_too_large")
        .when(actual > limit, "received_too_large")
        .when(actual == 0, "empty")
        .alias("error"),
    )


def media_type(col: Column) -> Column:
    """Content type without parameters, in lower case; null when there is none."""
    return F.lower(blank_to_null(F.split_part(col, F.lit(";"), F.lit(1))))


def _extension_table() -> dict[str, str]:
    # Derived from the standard library's own table, without the machine's mime.types files.
    table = mimetypes.MimeTypes(filenames=())
    names = sorted(set(table.types_map[True].values()) | set(table.types_map[False].values()))
    return {name: table.guess_extension(name) for name in names}


def attachment_name(disposition: Column, content_type: Column, media: Column, id_: Column) -> Column:
    """struct(filename, content_type, extension) from headers, falling back on the media type."""
    header = F.coalesce(disposition, F.lit(""))
    encoded = F.regexp_extract(header, r"(?i)filename\*\s*=\s*\"?[^';]*'[^';]*'([^\";]+)", 1)
    quoted = F.regexp_extract(header, r'(?i)filename\s*=\s*"([^"]*)"', 1)
    bare = strip(F.regexp_extract(header, r'(?i)filename\s*=\s*([^";]+)', 1))
    # In a percent-encoded name a plus sign is a plus sign.
    decoded = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    filename = F.coalesce(
        F.nullif(decoded, F.lit("")), F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit(""))
    )
    kind = F.coalesce(
        blank_to_null(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))),
        F.lit("application/octet-stream"),
    )
    known = F.create_map(*[F.lit(x) for pair in _extension_table().items() for x in pair])
    fallback = F.create_map(*[F.lit(x) for pair in DEFAULT_EXTENSIONS.items() for x in pair])
    from_name = F.when(
        filename.contains("."),
        F.concat(F.lit("."), F.lower(strip(F.substring_index(filename, ".", -1)))),
    )
    extension = F.coalesce(
        from_name, F.element_at(known, F.lower(kind)), F.element_at(fallback, media)
    )
    return F.struct(
        F.coalesce(filename, F.concat(id_.cast("string"), extension)).alias("filename"),
        kind.alias("content_type"),
        extension.alias("extension"),
    )
