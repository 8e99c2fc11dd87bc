"""URLs, origins, identifiers and user agents."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def cut_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def object_key(tenant: Column, session: Column, seq: Column) -> Column:
    return F.format_string("tenants/%s/sessions/%s/%06d.json.zst", tenant, session, seq)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID_PATTERN)


def origin_allowed(origin: Column, allowed: Column) -> Column:
    """Whether a browser origin is on an allow-list.

    An entry is an exact origin, or `scheme://host:*` for any port of one to five digits (or none). Case and one
    trailing slash of an entry do not count. A missing, blank or `null` origin, and the entry `*`, never match.
    """
    given = F.lower(origin)

    def matches(raw: Column) -> Column:
        entry = F.regexp_replace(F.lower(F.trim(raw)), "/$", "")
        any_port = F.endswith(entry, F.lit(":*"))
        base = F.regexp_replace(entry, ":[*]$", "")
        rest = F.substring(given, F.length(base) + 1, F.length(given))
        host_only = base.contains("://") & ~F.endswith(base, F.lit("/"))
        port_ok = (given == base) | (F.startswith(given, base) & rest.rlike("^:[0-9]{1,5}$"))
        return F.when(any_port, host_only & port_ok).otherwise((entry == given) & (entry != "*"))

    usable = (F.trim(origin) != "") & (origin != "null")
    return F.coalesce(usable & F.exists(allowed, lambda entry: F.coalesce(matches(entry), F.lit(False))), F.lit(False))


# How user agents name browsers. The first pattern that matches names the family.
BROWSER_FAMILIES = [
    ("Googlebot", r"Googlebot/(\d+)"),
    ("HeadlessChrome", r"HeadlessChrome/(\d+)"),
    ("Edge", r"(?:Edg|EdgA|EdgiOS|Edge)/(\d+)"),
    ("Opera", r"OPR/(\d+)"),
    ("Samsung Internet", r"SamsungBrowser/(\d+)"),
    ("Firefox", r"(?:Firefox|FxiOS)/(\d+)"),
    ("Chrome", r"(?:Chrome|CriOS)/(\d+)"),
    ("Safari", r"Version/(\d+)\S* (?:Mobile/\S+ )?Safari/"),
    ("curl", r"^curl/(\d+)"),
]
BOT_PATTERN = r"(?i)bot\b|spider|crawler|headless"
TABLET_PATTERN = r"iPad|Tablet"
MOBILE_PATTERN = r"iPhone|iPod|Mobile"
DESKTOP_PATTERN = r"Macintosh|Mac OS X|Windows|X11|Linux|CrOS|FreeBSD"
# End of fixed values.


def platform_of(ua: Column) -> Column:
    """`desktop`, `mobile` or `tablet`; null for bots and for anything unknown."""
    return (
        F.when(ua.isNull() | ua.rlike(BOT_PATTERN), F.lit(None).cast("string"))
        .when(ua.rlike(TABLET_PATTERN) | (ua.contains("Android") & ~ua.contains("Mobile")), F.lit("tablet"))
        .when(ua.rlike(MOBILE_PATTERN), F.lit("mobile"))
        .when(ua.rlike(DESKTOP_PATTERN), F.lit("desktop"))
    )


def browser_of(ua: Column) -> Column:
    """Family and major version, such as `Chrome 140`; null when no family is known."""
    chosen = F.lit(None).cast("string")
    for family, pattern in reversed(BROWSER_FAMILIES):
        chosen = F.when(ua.rlike(pattern), F.concat(F.lit(family + " "), F.regexp_extract(ua, pattern, 1))).otherwise(chosen)
    return chosen
