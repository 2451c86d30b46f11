"""Identifier texts derived from customers: numbers with right and wrong check digits, as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passgrid.functions.identifiers import VERHOEFF_D, VERHOEFF_P, check_digit, characters, let

# The inverse in the dihedral group, by which a check digit is appended.
VERHOEFF_INVERSE = [0, 4, 3, 2, 1, 5, 6, 7, 8, 9]
STATES = ["KA", "MH", "XX", "DL", "TN"]


def verhoeff_digit(digits: Column) -> Column:
    table = lambda rows: F.array(*[F.lit(x) for row in rows for x in row])
    permuted = F.transform(F.reverse(characters(F.concat(digits, F.lit("0")))), lambda x, i: F.element_at(table(VERHOEFF_P), (i % 8) * 10 + x.cast("int") + 1))
    end = F.aggregate(permuted, F.lit(0), lambda s, p: F.element_at(table(VERHOEFF_D), s * 10 + p + 1))
    return F.element_at(F.array(*[F.lit(x) for x in VERHOEFF_INVERSE]), end + 1)


def holder_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' keys, dealt to all cores: a row group of a million short rows is one task, and what is made of a row is long work."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return keys.repartition(4 * max(2, spark.sparkContext.defaultParallelism), "c_custkey")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One holder per customer: true values and a text that carries them in four layouts by key."""
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    eleven = F.concat(F.lit("2"), pad(k * 7919 % 10_000_000_000, 10))
    last = verhoeff_digit(eleven)
    birth = F.date_add(F.lit("1950-01-01").cast("date"), (k * 37 % 20000).cast("int"))
    number = F.concat(F.char(65 + k % 26), pad(k % 10_000_000, 7), F.lit("<"))
    expiry_year = 2020 + k % 15
    yymmdd = F.date_format(birth, "yyMMdd")
    exp6 = F.concat(pad(expiry_year % 100, 2), F.lit("1231"))
    b_digit = (check_digit(yymmdd) + F.when(k % 7 == 0, 1).otherwise(0)) % 10
    head = F.concat(number, check_digit(number), F.lit("IND"), yymmdd, b_digit, F.lit("M"), exp6, check_digit(exp6), F.lit("<" * 14), F.lit("0"))
    whole = lambda h: F.concat(h, check_digit(F.concat(F.substring(h, 1, 10), F.substring(h, 14, 7), F.substring(h, 22, 22))).cast("string"))
    out = holder_keys(spark, sf_dir).select(
        k.alias("k"),
        F.concat(eleven, ((last + F.when(k % 5 == 0, 1).otherwise(0)) % 10).cast("string")).alias("aadhaar"),
        F.concat(F.lit("ABC"), F.when(k % 6 == 0, "Z").otherwise("P"), F.char(65 + k % 26), pad(k % 10000, 4), F.char(65 + k * 7 % 26)).alias("pan"),
        F.concat(F.element_at(F.array(*[F.lit(s) for s in STATES]), (k % 5 + 1).cast("int")), pad(k % 90 + 10, 2), (1950 + k % 70).cast("string"), pad(k % 10_000_000, 7)).alias("licence"),
        F.concat(F.lit("XY"), F.char(65 + k % 26), pad(k % 10_000_000, 7)).alias("voter"),
        F.concat(F.lit("9"), pad(k * 31 % 1_000_000_000, 9)).alias("phone"),
        F.concat(F.lit("7"), pad(k % 90000, 5)).alias("pin"),
        birth.alias("dob"),
        F.make_date(expiry_year.cast("int"), F.lit(12), F.lit(31)).alias("expiry"),
        F.rpad(F.concat(F.lit("P<INDSURNAME"), F.char(65 + k % 26), F.lit("<<GIVEN<NAME")), 44, "<").alias("mrz1"),
        let(head, whole).alias("mrz2"),
    )
    spaced = F.concat_ws(" ", F.substring("aadhaar", 1, 4), F.substring("aadhaar", 5, 4), F.substring("aadhaar", 9, 4))
    k2 = F.col("k")
    pan = F.when(k2 % 4 == 1, F.concat_ws(" ", F.left("pan", F.lit(5)), F.substring("pan", 6, 4), F.right("pan", F.lit(1)))).when(k2 % 4 == 2, F.concat(F.left("pan", F.lit(5)), F.replace(F.substring("pan", 6, 4), F.lit("0"), F.lit("O")), F.right("pan", F.lit(1)))).otherwise(F.col("pan"))
    text = F.concat_ws("\n", F.lit("REPUBLIC"), F.when(k2 % 2 == 0, F.concat(F.lit("VALID TILL: "), F.date_format("expiry", "dd-MM-yyyy"))).otherwise(F.concat(F.lit("EXPIRY "), F.date_format("expiry", "yyyy-MM-dd"))),
                      F.concat(F.when(k2 % 3 == 0, "DOB: ").otherwise("Born "), F.date_format("dob", "dd-MM-yyyy")), spaced, F.concat(F.lit("PIN "), F.col("pin")), F.concat(F.lit("Ph "), F.col("phone")), F.col("voter"))
    return out.withColumn("text", text).withColumn("pan_text", F.regexp_replace(pan.cast("string"), "^", "id ")).withColumn("mrz_text", F.concat_ws("\n", F.lit("noise line"), "mrz1", "mrz2"))


def flat(rows: list[list[int]]) -> str:
    return "[" + ",".join(str(x) for row in rows for x in row) + "]"


def verhoeff_sql(digits: str) -> str:
    permuted = f"list_transform(list_reverse(string_split({digits}, '')), lambda c, i: {flat(VERHOEFF_P)}[((i - 1) % 8) * 10 + CAST(c AS INTEGER) + 1])"
    return f"list_reduce(list_prepend(0, {permuted}), lambda s, p: {flat(VERHOEFF_D)}[s * 10 + p + 1])"


def check_digit_sql(text: str) -> str:
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE 0 END"
    return f"CAST(list_sum(list_transform(string_split({text}, ''), lambda c, i: ({value}) * [7,3,1][(i - 1) % 3 + 1])) % 10 AS INTEGER)"


_PAD = "lpad(CAST({} AS VARCHAR), {}, '0')"
IDENTIFIERS_SQL = f"""
    SELECT *, concat_ws(chr(10), 'REPUBLIC', CASE WHEN k % 2 = 0 THEN 'VALID TILL: ' || strftime(expiry, '%d-%m-%Y') ELSE 'EXPIRY ' || strftime(expiry, '%Y-%m-%d') END,
        CASE WHEN k % 3 = 0 THEN 'DOB: ' ELSE 'Born ' END || strftime(dob, '%d-%m-%Y'), aadhaar[1:4] || ' ' || aadhaar[5:8] || ' ' || aadhaar[9:12], 'PIN ' || pin, 'Ph ' || phone, voter) AS text,
        concat_ws(chr(10), 'noise line', mrz1, mrz2) AS mrz_text
    FROM (SELECT *, head || {check_digit_sql("head[1:10] || head[14:20] || head[22:43]")} AS mrz2 FROM (
        SELECT *, number || {check_digit_sql("number")} || 'IND' || b6 || (({check_digit_sql("b6")} + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) % 10) || 'M' || e6 || {check_digit_sql("e6")} || repeat('<', 14) || '0' AS head,
            eleven || (({flat([VERHOEFF_INVERSE])}[{verhoeff_sql("eleven || '0'")} + 1] + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 10) AS aadhaar,
            rpad('P<INDSURNAME' || chr(CAST(65 + k % 26 AS INTEGER)) || '<<GIVEN<NAME', 44, '<') AS mrz1 FROM (
            SELECT c_custkey AS k, '2' || {_PAD.format("c_custkey * 7919 % 10000000000", 10)} AS eleven,
                'ABC' || CASE WHEN c_custkey % 6 = 0 THEN 'Z' ELSE 'P' END || chr(CAST(65 + c_custkey % 26 AS INTEGER)) || {_PAD.format("c_custkey % 10000", 4)} || chr(CAST(65 + c_custkey * 7 % 26 AS INTEGER)) AS pan,
                ['KA','MH','XX','DL','TN'][CAST(c_custkey % 5 AS INTEGER) + 1] || {_PAD.format("c_custkey % 90 + 10", 2)} || (1950 + c_custkey % 70) || {_PAD.format("c_custkey % 10000000", 7)} AS licence,
                'XY' || chr(CAST(65 + c_custkey % 26 AS INTEGER)) || {_PAD.format("c_custkey % 10000000", 7)} AS voter, '9' || {_PAD.format("c_custkey * 31 % 1000000000", 9)} AS phone, '7' || {_PAD.format("c_custkey % 90000", 5)} AS pin,
                DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS dob, make_date(2020 + c_custkey % 15, 12, 31) AS expiry, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || {_PAD.format("c_custkey % 10000000", 7)} || '<' AS number,
                strftime(DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER), '%y%m%d') AS b6, {_PAD.format("(2020 + c_custkey % 15) % 100", 2)} || '1231' AS e6 FROM customer)))"""
