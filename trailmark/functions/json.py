"""Small JSON tests and reads on string columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.schemas import REPLAY_EVENTS


def prop(props: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(props, f"$.{path}"), F.lit(default))


def is_object(text: Column) -> Column:
    """Whether a JSON text is an object, duplicates included."""
    return F.coalesce(_opens(text), F.lit(False))


def _opens(text: Column) -> Column:
    """Patterns are for texts with space at their ends, which are rare: most are decided by one character."""
    return F.startswith(text, F.lit("{")) | text.rlike(r"^\s*\{")


def _closes(text: Column) -> Column:
    return F.endswith(text, F.lit("}")) | text.rlike(r"\}\s*$")


def is_storable_object(text: Column) -> Column:
    """An object the store takes: well formed, and no key twice at any depth."""
    return is_object(text) & F.try_parse_json(text).isNotNull()


def is_single_object(text: Column) -> Column:
    """Exactly one JSON object and nothing behind it."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    with_more = F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2
    return F.coalesce(_opens(text) & _closes(text) & alone & with_more, F.lit(False))


def replay_events(text: Column) -> Column:
    """The recorded events of a chunk as `array<struct<type, timestamp>>`; null if it is no array."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, REPLAY_EVENTS))


def all_have_timestamps(events: Column) -> Column:
    """Every element is an object with a numeric `timestamp`."""
    return F.coalesce(
        (F.size(events) > 0) & F.forall(events, lambda e: e.isNotNull() & e["timestamp"].isNotNull()), F.lit(False)
    )
