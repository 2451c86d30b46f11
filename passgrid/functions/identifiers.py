"""Identifier normalisation, masks and check rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped by normalisation, the Verhoeff tables, PAN holder categories, state codes, passport series.
DROPPED = " -/\\._:()"
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]
PAN_CATEGORIES = "ABCDFGHLJPT"
STATE_CODES = "AP AR AS BR CG CH DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS UK UP UT WB".split()
LICENCE_STATES = "AN AP AR AS BR CH CG DN DD DL GA GJ HR HP JK JH KA KL LA LD MP MH MN ML MZ NL OD PB RJ SK TN TS TR UP UK WB".split()
PASSPORT_SERIES = {
    "A": (1999, 2002), "B": (1999, 2002), "C": (2002, 2005), "D": (2003, 2006), "E": (2004, 2007), "F": (2005, 2008),
    "G": (2006, 2009), "H": (2007, 2010), "J": (2008, 2012), "K": (2012, 2015), "L": (2013, 2016), "M": (2014, 2017),
    "N": (2016, 2019), "P": (2018, 2021), "R": (2019, 2022), "S": (2020, 2023), "T": (2021, 2024), "V": (2022, 2025),
    "W": (2022, 2026), "X": (2023, 2027), "Y": (2024, 2027), "Z": (2024, 2028),
}


def norm(c: Column) -> Column:
    """Without blanks and punctuation, upper case.  Compatibility forms (NFKC) are folded by ``nfkc`` first where a column may hold them."""
    return F.upper(F.trim(F.translate(c, DROPPED, "")))


def mask(c: Column, keep: int = 4) -> Column:
    n = norm(c)
    return F.when(F.length(n) > keep, F.concat(F.repeat(F.lit("*"), F.length(n) - keep), F.right(n, F.lit(keep)))).otherwise(n)


def fingerprint(c: Column) -> Column:
    return F.sha2(norm(c), 256)


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def characters(c: Column) -> Column:
    """The text's characters (none of an empty text)."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def character_value(c: Column) -> Column:
    """0-9 and A-Z as 0 to 35, anything else 0."""
    return F.when(c.rlike("^[0-9]$"), c.try_cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(0)


#: Letters and what their values come to modulo 10.
LETTER_DIGITS = "".join(chr(65 + i) for i in range(26)), "".join(str((10 + i) % 10) for i in range(26))


def check_digit(c: Column) -> Column:
    """Weights 7, 3, 1 over character values, modulo 10.

    Only last digits of values count, so three characters are a number abc, and 7a + 3b + c ends
    like the number, three times its tens and seven times its hundreds together.
    """
    digits = F.regexp_replace(F.translate(c, *LETTER_DIGITS), "[^0-9]", "0")
    threes = F.regexp_extract_all(F.concat(digits, F.lit("00")), F.lit("[0-9]{3}"), F.lit(0))
    whole = lambda x, by: F.call_function("div", x, F.lit(by)).cast("int")
    numbers = F.transform(threes, lambda x: x.cast("int"))
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x + whole(x, 10) * 3 + whole(x, 100) * 7) % 10


def _table(rows: list[list[int]]) -> Column:
    return F.array(*[F.lit(x) for row in rows for x in row])


def verhoeff(c: Column) -> Column:
    """Exactly twelve digits whose permuted products in the dihedral group end at 0."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    permuted = F.transform(F.reverse(characters(digits)), lambda x, i: F.element_at(_table(VERHOEFF_P), (i % 8) * 10 + x.cast("int") + 1))
    end = F.aggregate(permuted, F.lit(0), lambda s, p: F.element_at(_table(VERHOEFF_D), s * 10 + p + 1))
    return (F.length(digits) == 12) & (end == 0)


def check(label: str, ok: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), ok.cast("boolean").alias("ok"))


def aadhaar_checks(c: Column) -> list[Column]:
    n = F.regexp_replace(F.coalesce(c, F.lit("")), "[ -]", "")
    shaped = n.rlike("^[2-9][0-9]{11}$")
    return [check("structure", shaped), check("verhoeff-checksum", shaped & verhoeff(n))]


def pan_check_character(first9: Column) -> Column:
    r = F.aggregate(F.transform(characters(first9), character_value), F.lit(0), lambda s, x: s + x) % 36
    return F.when(r < 10, r.cast("string")).otherwise(F.char(r + 55))


def pan_checks(c: Column) -> list[Column]:
    """Structure, holder category, and the check character as a hint: true or undecided, never false."""
    n = norm(c)
    category = (F.length(n) == 10) & F.substring(n, 4, 1).isin(*PAN_CATEGORIES)
    hint = F.when((F.length(n) == 10) & (pan_check_character(F.substring(n, 1, 9)) == F.substring(n, 10, 1)), True)
    return [check("structure", n.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")), check("category-letter", category), check("check-char", hint)]


def licence_checks(c: Column) -> list[Column]:
    n = norm(c)
    return [check("structure", n.rlike("^[A-Z]{2}[0-9]{13,14}$|^[A-Z]{2}[0-9]{2}(?:19|20)[0-9]{2}[0-9]{4,7}$"))]


def vehicle_checks(c: Column) -> list[Column]:
    return [check("structure", norm(c).rlike("^[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}$"))]


def voter_checks(c: Column) -> list[Column]:
    return [check("structure", norm(c).rlike("^[A-Z]{3}[0-9]{7}$"))]


def nepal_checks(c: Column) -> list[Column]:
    n = norm(c)
    return [check("structure", F.when(n != "", n.rlike("^[0-9]{5,20}$")))]


def bhutan_checks(c: Column) -> list[Column]:
    n = norm(c)
    return [check("structure", F.when(n != "", n.rlike("^[0-9]{11}$")))]


def passport_checks(c: Column, mrz_number: Column) -> list[Column]:
    """Structure, and agreement of the last five characters with the machine-readable number (undecided without one)."""
    n, m = norm(c), F.rtrim(F.regexp_replace(F.coalesce(mrz_number, F.lit("")), "<+$", ""))
    agree = F.when((m != "") & (n != ""), F.right(n, F.lit(5)) == F.right(m, F.lit(5)))
    return [check("structure", n.rlike("^[A-Z][0-9]{7}$|^[A-Z][0-9]{6}[A-Z]$|^[A-Z0-9]{8,9}$")), check("mrz-agreement", agree)]


def licence_details(c: Column, year: Column) -> Column:
    """Parts of a licence number, and whether its state is known and its year lies between 1960 and the one given."""
    n = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\s\-_/]", "")
    full, older = r"^([A-Z]{2})([0-9]{2})([0-9]{4})([0-9]{7})$", r"^([A-Z]{2})([0-9]{2})([12][0-9]{3})([0-9]{4,7})$"
    part = lambda i: F.when(n.rlike(full), F.regexp_extract(n, full, i)).when(n.rlike(older), F.regexp_extract(n, older, i))
    state, issued = part(1), part(3).try_cast("int")
    known = state.isin(*LICENCE_STATES)
    return F.struct(
        F.coalesce(known & issued.between(F.lit(1960), year), F.lit(False)).alias("valid"),
        F.when(known, state).alias("state"), F.when(known, F.concat(state, part(2))).alias("rto"), F.when(known, issued).alias("year"),
    )


def serial_checks(kind: Column, c: Column, dob: Column) -> Column:
    """Plausibility of a serial: passport series against the holder's age, licence state, PAN holder type."""
    n = norm(c)
    series = F.substring(n, 1, 1)
    start = F.element_at(F.create_map(*[F.lit(x) for k, v in PASSPORT_SERIES.items() for x in (k, v[0])]), F.when(series.isin(*PASSPORT_SERIES), series))
    born = F.year(F.try_to_date(F.substring(dob, 1, 10)))
    era = check("serial-era", F.when(start.isNotNull(), True))
    anachronism = F.when(start.isNotNull() & born.isNotNull(), check("serial-anachronism", F.when(start >= born + 18 - 5, True)))
    state = check("state-code", F.substring(n, 1, 2).isin(*STATE_CODES))
    entity = check("pan-entity-type", F.when(F.substring(n, 4, 1) == "P", True))
    return (
        F.when((kind == "passport") & (n != ""), F.array_compact(F.array(era, anachronism)))
        .when((kind == "driving_licence") & (F.length(n) >= 2), F.array(state))
        .when((kind == "pan") & (F.length(n) == 10), F.array(entity))
        .otherwise(F.array().cast("array<struct<label:string,ok:boolean>>"))
    )


def resolved(declared: Column, ocr: Column, mrz: Column) -> Column:
    """The number by precedence, its source, and whether the sources that have one differ."""
    values = [F.when(norm(x) != "", norm(x)) for x in (declared, ocr, mrz)]
    source = F.when(values[0].isNotNull(), "declared").when(values[1].isNotNull(), "ocr").when(values[2].isNotNull(), "mrz")
    return F.struct(F.coalesce(*values).alias("number"), source.alias("source"), (F.size(F.array_distinct(F.array_compact(F.array(*values)))) > 1).alias("mismatch"))


def checks_verdict(checks: Column) -> Column:
    """FAIL if only failures, PASS if only passes, REVIEW if both or if a cross-field check failed, UNVERIFIED without any."""
    failed = F.exists(checks, lambda x: x["ok"] == F.lit(False))
    passed = F.exists(checks, lambda x: x["ok"] == F.lit(True))
    cross = F.exists(checks, lambda x: x["label"].startswith("cross-field") & (x["ok"] == F.lit(False)))
    return F.when(cross, "REVIEW").when(failed & passed, "REVIEW").when(failed, "FAIL").when(passed, "PASS").otherwise("UNVERIFIED")
