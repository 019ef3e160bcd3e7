"""Class names, camera ids, time text and other scalar text functions (all native columns)."""

from __future__ import annotations

import functools
import itertools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that count as a person, and names excluded from the object tasks.
PERSON_SYNONYMS = ["person", "persons", "personne", "personnes", "human", "humain"]
PERSON_NAMES = ["person", "personne", "human", "humain"]
OBJECT_TASK_IGNORED = ["personne", "person", "persons", "people"]
ALLOWED_VEHICLES = ["car", "truck", "bicycle", "motorcycle"]

# Label vocabulary (position = class id) and spelling corrections.
LABEL_VOCABULARY = ["maillet", "marteau", "niveau à bulle", "scie", "tabouret", "téléphone", "verre"]
LABEL_CORRECTIONS = {
    "amrteau": "marteau",
    "mailet": "maillet",
    "maillety": "maillet",
    "mailley": "maillet",
    "télé^phone": "téléphone",
    "5": "verre",
}

# Accepted spellings of an annotated yes / no and the columns it may stand in.
TRUE_WORDS = ["1", "true", "yes", "y", "oui", "o", "same", "correct"]
FALSE_WORDS = ["0", "false", "no", "n", "non", "different", "incorrect"]
TRUTH_COLUMNS = ["expected_same", "same_person", "same_object", "is_correct", "correct", "same"]


def _decompositions(keep) -> tuple[str, str, str]:
    """Compatibility decompositions of all of Unicode, of each only the characters that ``keep`` accepts.

    Characters that become one are a ``translate`` table (its second part is shorter by those that become none), those that
    become several a text that ``str_to_map`` reads. All come from the Unicode tables, none is typed in.
    """
    one, none, several = [], [], []
    for code in itertools.chain(range(0x80, 0xD800), range(0xE000, sys.maxunicode + 1)):
        char = chr(code)
        text = "".join(x for x in unicodedata.normalize("NFKD", char) if keep(x))
        if not text:
            none.append(char)
        elif len(text) > 1:
            several.append(f"{char}\x02{text}")
        elif text != char:
            one.append((char, text))
    return "".join(c for c, _ in one) + "".join(none), "".join(t for _, t in one), "\x01".join(several)


@functools.cache
def _ascii_tables() -> tuple[str, str, str]:
    """Without the characters that become nothing: what is not ASCII in the end is removed by its range."""
    source, target, several = _decompositions(str.isascii)
    return source[:len(target)], target, several


@functools.cache
def _mark_tables() -> tuple[str, str, str]:
    return _decompositions(lambda x: not unicodedata.combining(x))


def _folded(c: Column, tables: tuple[str, str, str]) -> Column:
    """Each character's decomposition; a text is taken apart only if it has characters that become several."""
    source, target, several = tables
    wide = F.str_to_map(F.lit(several), F.lit("\x01"), F.lit("\x02"))
    single = F.translate(c, source, target)
    spelled = F.array_join(F.transform(F.split(single, ""), lambda ch: F.when(
        ch.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_element_at(wide, ch), ch)).otherwise(ch)), "")
    return F.when(single.rlike(r"[^\x00-\x7F]"), spelled).otherwise(single)


def to_ascii(c: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII; plain ASCII text skips the work."""
    folded = F.regexp_replace(_folded(c, _ascii_tables()), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def strip(c: Column) -> Column:
    """Without white space at either end (all of Unicode's, and the four separators 1C to 1F)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def strip_accents(c: Column) -> Column:
    """Drop combining marks after decomposition, keep every other character."""
    folded = _folded(c, _mark_tables())
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def class_key(name: Column, class_id: Column) -> Column:
    """Class key of the fusion step: ASCII, lower case, underscores as blanks, person synonyms merged."""
    fallback = class_id.cast("string")
    raw = F.coalesce(F.nullif(name, F.lit("")), fallback)
    ascii_name = _let(raw, to_ascii)
    squeezed = F.trim(F.regexp_replace(F.translate(F.lower(ascii_name), "_", " "), r"\s+", " "))
    return _let(
        squeezed,
        lambda k: F.when(k.isin(PERSON_SYNONYMS), F.lit("person")).when(k == "", fallback).otherwise(k),
    )


def normalize_class(name: Column) -> Column:
    """Class key of the evaluation steps: accents dropped, lower case, trimmed."""
    return strip(F.lower(strip_accents(name)))


def alert_class_key(name: Column) -> Column:
    """Class key of the alert step: white space at the ends dropped, lower case."""
    return F.lower(strip(name))


def is_person(class_id: Column, name: Column, person_ids: list[int]) -> Column:
    return class_id.isin(person_ids) | alert_class_key(name).isin(PERSON_NAMES)


def is_ignored_for_objects(name: Column) -> Column:
    return normalize_class(name).isin(OBJECT_TASK_IGNORED)


def is_allowed_vehicle(name: Column) -> Column:
    return name.isin(ALLOWED_VEHICLES)


def live_kind(class_id: Column, person_id: int = 11, object_max: int = 12) -> Column:
    """Live rule on numeric ids: person, object or nothing."""
    return F.when(class_id == person_id, "person").when(class_id <= object_max, "object")


def fix_class_name(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LABEL_CORRECTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), name)


def label_class_id(name: Column) -> Column:
    """Position in the closed vocabulary, NULL for an unknown class."""
    position = F.array_position(F.array(*[F.lit(v) for v in LABEL_VOCABULARY]), name)
    return F.nullif(position, F.lit(0).cast("bigint")) - 1


def truth_flag(columns: list[Column]) -> Column:
    """First non-empty annotation among ``columns`` as a boolean; NULL if unannotated, error if unreadable."""
    raw = F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
    word = F.lower(strip(raw))
    return (
        F.when(raw.isNull(), F.lit(None).cast("boolean"))
        .when(word.isin(TRUE_WORDS), True)
        .when(word.isin(FALSE_WORDS), False)
        .otherwise(F.raise_error(F.concat(F.lit("cannot read truth value: "), raw)).cast("boolean"))
    )


def canonical_pair(cam_a: Column, track_a: Column, cam_b: Column, track_b: Column) -> Column:
    """Unordered pair of (camera, track) sides as one struct, smaller side first (text order)."""
    left = F.struct(strip(cam_a).alias("cam"), strip(track_a.cast("string")).alias("track"))
    right = F.struct(strip(cam_b).alias("cam"), strip(track_b.cast("string")).alias("track"))
    low, high = F.least(left, right), F.greatest(left, right)
    return F.struct(
        low["cam"].alias("cam_a"), low["track"].alias("track_a"),
        high["cam"].alias("cam_b"), high["track"].alias("track_b"),
    )


def _cam_number(digits: Column) -> Column:
    number = digits.cast("bigint").cast("string")
    return F.concat(F.lit("cam_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))


# Fixed value: the accepted form of a camera name.
_CAM = r"[Cc]am(?:era)?[\s_]*(\d+)"


def camera_id_from_file(stem: Column) -> Column:
    """Camera id with its recording suffix, from a video file stem."""
    digits = F.regexp_extract(stem, _CAM, 1)
    suffix = F.lower(F.replace(F.regexp_extract(stem, _CAM + r"[\s_]+\d+\.\d+[\s_]+(.*)", 2), F.lit(" "), F.lit("_")))
    cam = _cam_number(digits)
    return (
        F.when(digits == "", F.lower(F.replace(stem, F.lit(" "), F.lit("_"))))
        .when(suffix != "", F.concat_ws("_", cam, suffix))
        .otherwise(cam)
    )


def base_camera_id(cam_id: Column) -> Column:
    """``cam_XX`` of a session-stamped id or of a file-derived name."""
    two = F.regexp_extract(cam_id, r"cam_(\d{2})", 1)
    any_digits = F.regexp_extract(cam_id, _CAM, 1)
    return (
        F.when(two != "", F.concat(F.lit("cam_"), two))
        .when(any_digits != "", _cam_number(any_digits))
        .otherwise(cam_id)
    )


def clock_text(ms: Column) -> Column:
    """Milliseconds as ``MM:SS.mmm``."""
    total = ms / F.lit(1000.0)
    minutes = F.floor(total / 60)
    seconds = total - minutes * 60
    whole = F.floor(seconds)
    millis = F.bround((seconds - whole) * 1000).cast("bigint")
    return F.format_string("%02d:%02d.%03d", minutes.cast("bigint"), whole.cast("bigint"), millis)


def frame_to_seconds(frame: Column, fps: float = 25.0) -> Column:
    return frame.cast("double") / F.lit(fps)


def seconds_to_frame(seconds: Column, fps: float = 25.0) -> Column:
    return F.floor(seconds * F.lit(fps)).cast("bigint")


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields 0.0 on a zero or missing denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def safe_double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def alert_id(run_id: Column, kind: Column, gid: Column, zone: Column, name: Column, frame: Column) -> Column:
    """Eight hex digits derived from what the alert is about, so a re-run gives the same id."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (run_id, kind, gid, zone, name, frame)]
    return F.substring(F.sha2(F.concat_ws(",", *parts), 256), 1, 8)


def alert_log_line(alert: dict[str, Column]) -> Column:
    """The one-line text form of an alert."""
    zone = F.when(F.coalesce(alert["zone_id"], F.lit("")) == "", "").otherwise(
        F.concat(F.lit(" zone="), alert["zone_id"])
    )
    return F.format_string(
        "Alert[%s] %s:%s%s gid=%d pos=(%.2fm,%.2fm) cams=%s conf=%.2f",
        alert["alert_id"], alert["alert_type"], alert["alert_level"], zone, alert["global_id"],
        F.bround(alert["x_m"], 2), F.bround(alert["y_m"], 2), F.concat_ws("+", alert["cameras"]),
        F.bround(alert["confidence"], 2),
    )
