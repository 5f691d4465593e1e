"""Values as column expressions: names, numbers, comparison, places, guards. No Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import ALIASES, LANGUAGES, RANGES, lookup

NUMBER = r"[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)"
AUX_PATH = r"(?i)(^|[/\\_.\-])(test|tests|eval|demo|tmp|spec|example|examples|tutorial|sample|colab|benchmark|notebook)"


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^args\.", ""), r"[\s_-]+", " "))


def canonical_key(name: Column) -> Column:
    """The parameter that a name stands for; null for an unknown one."""
    return lookup(normalize_name(name), ALIASES)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the number of times that it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_PRODUCT, _POWER, _SCALED = r"^([0-9.]+)[×xX*]10\^?(-?[0-9]+)$", r"^10(?:\^(-?[0-9]+)|(-[0-9]+))$", r"^([0-9.]+)\s*([kKMGB])$"


def normalize_number(raw: Column) -> Column:
    """A text as a double; null if it is none. Percent signs do not scale; superscripts, typographic minus signs,
    thousands separators, powers of ten and the suffixes k, K, M, G and B are read. A bare number that starts
    with 10 is itself: a power of ten needs its caret, a superscript or a sign."""
    raised = F.regexp_replace(F.trim(raw.cast("string")), "([⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)$", "^$1")
    plain = F.trim(F.regexp_replace(F.translate(raised, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−–—", "0123456789----"), "%$", ""))
    joined = lambda x: F.when(x.rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(x)

    def read(s: Column) -> Column:
        tight = F.replace(s, F.lit(" "), F.lit(""))
        exponent = F.concat(F.regexp_extract(tight, _POWER, 1), F.regexp_extract(tight, _POWER, 2))
        scale = lookup(F.regexp_extract(s, _SCALED, 2), {"k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "B": 1e9})
        # one cast of "ae-b" rounds once, where a product of two doubles would round twice
        return (
            F.when(s.rlike(f"^{NUMBER}$"), s.try_cast("double"))
            .when(tight.rlike(_PRODUCT), F.concat(F.regexp_extract(tight, _PRODUCT, 1), F.lit("e"), F.regexp_extract(tight, _PRODUCT, 2)).try_cast("double"))
            .when(tight.rlike(_POWER), F.concat(F.lit("1e"), exponent).try_cast("double"))
            .when(s.rlike(_SCALED), F.regexp_extract(s, _SCALED, 1).try_cast("double") * scale)
        )

    return bound(bound(plain, joined), read)


def compare_form(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s_-]+", ""))


def numbers_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Null if either is null; zero equals only zero."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda x: _equal(x["a"], x["b"], tolerance))


def _equal(a: Column, b: Column, tolerance: float) -> Column:
    close = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) <= tolerance
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(a == b, True).when((a == 0) | (b == 0), False).otherwise(close)


def values_equal(a: Column, b: Column) -> Column:
    """Numeric where both are numbers, else equal in their comparable form."""
    return F.coalesce(numbers_equal(normalize_number(a), normalize_number(b)), compare_form(a) == compare_form(b))


def text_match(a: Column, b: Column) -> Column:
    """Texts that are equal or of which one holds the other; never numbers."""
    numeric = normalize_number(a).isNotNull() | normalize_number(b).isNotNull()
    held = bound(F.struct(compare_form(a).alias("x"), compare_form(b).alias("y")), lambda s: (s["x"] != "") & (s["y"] != "") & (F.contains(s["x"], s["y"]) | F.contains(s["y"], s["x"])))
    return F.coalesce(~numeric & held, F.lit(False))


def within_range(key: Column, number: Column, ranges: dict[str, tuple[float, float, bool]]) -> Column:
    """True or false by the key's range; null without a rule or a number."""
    rule = lookup(key, {name: f"{float(low)!r},{float(high)!r},{int(whole)}" for name, (low, high, whole) in ranges.items()})

    def fits(x: Column) -> Column:
        part = lambda i: F.split(x["rule"], ",")[i].cast("double")
        whole = (part(2) == 0) | (F.abs(x["v"] - F.rint(x["v"])) <= 1e-9)
        return F.when(x["rule"].isNotNull(), (x["v"] >= part(0)) & (x["v"] <= part(1)) & whole)

    return bound(F.struct(rule.alias("rule"), number.alias("v")), fits)


def is_plausible(key: Column, raw: Column) -> Column:
    return within_range(key, normalize_number(raw), RANGES)


def first_reason(guards: list[tuple[str, Column]]) -> Column:
    """The name of the first guard that holds, in this order; null if none does."""
    return F.coalesce(*[F.when(holds, name) for name, holds in guards])


def is_thin(text: Column, least: int = 120) -> Column:
    return F.length(F.trim(text)) < least


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def fingerprint(content: Column) -> Column:
    """The first ten hexadecimal digits of the SHA-1 of some bytes."""
    return F.substring(F.sha1(content), 1, 10)


def cache_key(mode: str, prompt: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(mode), F.lit("\x00"), prompt).cast("binary"), 256), 1, 24)


def region_key(image: Column, model: Column, prompt: Column) -> Column:
    return F.substring(F.sha1(F.concat(image, model.cast("binary"), prompt.cast("binary"))), 1, 16)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    return lookup(extension(path), LANGUAGES)


def is_aux(path: Column) -> Column:
    return path.rlike(AUX_PATH)


def location_file(location: Column) -> Column:
    return F.regexp_extract(location, r"^([^:]+?)(?:\(config\)|\[cell\d+\]:L\d+|:\d+)?$", 1)


def location_line(location: Column) -> Column:
    return F.regexp_extract(location, r":(\d+)$", 1).try_cast("int")


def location_page(location: Column) -> Column:
    return F.regexp_extract(location, r"^Page (\d+)", 1).try_cast("int")


def occurrences(text: Column, part: Column) -> Column:
    """How often a text holds another one, without overlaps and case."""
    low, p = F.lower(text), F.lower(part)
    return F.when(F.length(p) > 0, (F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)).otherwise(0).cast("long")


def general_number(x: Column) -> Column:
    """A number without a needless fraction, as texts and patches show it."""
    return F.when((x == F.rint(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def evidence_score(location: Column, known: Column) -> Column:
    """How much a place in code counts: training entry, configuration, tests and examples, and a literal value."""
    low = F.lower(location)
    weigh = lambda holds, points: F.when(holds, points).otherwise(0)
    return (
        weigh(low.rlike(r"\btrain"), 4)
        + weigh(F.contains(low, F.lit("config")) | F.contains(low, F.lit("option")), 2)
        - weigh(low.rlike(AUX_PATH) | F.contains(low, F.lit("[cell")), 5)
        + weigh(known, 2)
    )
