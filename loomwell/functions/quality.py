"""Quality scores of files and lines, and the purge rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fmt import fixed

# Word lists, marks, limits and issue names.
STOP = [" o ", " a ", " de ", " que ", " e ", " do ", " da ", " em ", " um ", " para "]
ENGLISH = [" the ", " and ", " is ", " with ", " for "]
SPANISH = [" y ", " el ", " los ", " las ", " una "]
BROKEN = ["Ã£", "Ã©", "Ã³"]
SYMBOLS = r"[{\[\]}<>@#$%=|\\]"
ISSUES = {
    "short": "Muito curto", "broken": "Encoding quebrado", "few": "Poucas palavras", "unnatural": "Texto não-natural (sem conectivos)", "repetitive": "Repetitivo demais",
    "poor": "Vocabulário pobre", "chopped": "Frases fragmentadas", "endless": "Frases longas demais", "markup": "Markup/Código", "english": "Inglês", "spanish": "Espanhol",
}
UNREADABLE = "Erro leitura"
APPROVED = 50.0


def occurrences(text: Column, needles: list[str]) -> Column:
    """Non-overlapping occurrences of each needle, summed."""
    return sum((F.size(F.split(text, n)) - 1 for n in needles[1:]), F.size(F.split(text, needles[0])) - 1)


def file_features(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    words = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    return {
        "bytes": F.octet_length(text), "broken": F.contains(text, F.lit(BROKEN[0])) | F.contains(text, F.lit(BROKEN[1])) | F.contains(text, F.lit(BROKEN[2])),
        "words": F.size(words), "distinct": F.size(F.array_distinct(words)), "stops": occurrences(low, STOP), "english": occurrences(low, ENGLISH), "spanish": occurrences(low, SPANISH),
        "sentences": F.size(F.split(text, r"[.!?]")), "symbols": F.regexp_count(text, F.lit(SYMBOLS)),
    }


def file_rules() -> list[tuple[str, Column, float]]:
    """(issue, condition, loss) over the columns of file_features, in order."""
    words = F.greatest(F.col("words"), F.lit(1)).cast("double")
    stop, rich, mean = F.col("stops") / words, F.col("distinct") / words, F.col("words").cast("double") / F.col("sentences")
    return [
        ("few", F.col("words") < 50, 20.0), ("unnatural", stop < 0.05, 40.0), ("repetitive", stop > 0.6, 30.0), ("poor", rich < 0.05, 30.0), ("chopped", mean < 4, 20.0),
        ("endless", mean > 150, 20.0), ("markup", F.col("symbols").cast("double") / F.greatest(F.col("bytes"), F.lit(1)) > 0.05, 30.0),
    ]


def score_files(df, text: str = "text"):
    """Adds bytes, score and issues.  Short and broken texts stop at once; English sets the
    score to 0 before Spanish takes 60, and neither hides the other issues."""
    df = df.withColumns(file_features(F.col(text)))
    rules = file_rules()
    score = F.lit(100.0) - sum((F.when(c, loss).otherwise(0.0) for _, c, loss in rules[1:]), F.when(rules[0][1], rules[0][2]).otherwise(0.0))
    is_en, is_es = F.col("english") > F.col("stops"), F.col("spanish") > F.expr("stops div 2")
    score = F.greatest(F.when(is_en, 0.0).otherwise(score) - F.when(is_es, 60.0).otherwise(0.0), F.lit(0.0))
    issues = F.array_compact(F.array(*[F.when(c, ISSUES[n]) for n, c, _ in rules], F.when(is_en, ISSUES["english"]), F.when(is_es, ISSUES["spanish"])))
    short, broken = F.col("bytes") < 500, F.col("broken")
    return df.withColumns({
        "score": F.when(short | broken, 0.0).otherwise(score),
        "issues": F.when(short, F.array(F.lit(ISSUES["short"]))).when(broken, F.array(F.lit(ISSUES["broken"]))).otherwise(issues),
    })


def score_contents(df, content: str = "content"):
    """score_files over the bytes of files; what is not UTF-8 is unreadable: score 0, no bytes."""
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    df = df.withColumn("readable", valid).withColumn("text", F.when(valid, F.col(content).cast("string")).otherwise(""))
    df = score_files(df)
    return df.withColumns({
        "bytes": F.when(F.col("readable"), F.col("bytes")).otherwise(0), "score": F.when(F.col("readable"), F.col("score")).otherwise(0.0),
        "issues": F.when(F.col("readable"), F.col("issues")).otherwise(F.array(F.lit(UNREADABLE))),
    }).drop("readable")


# Fixed values of the line audit: accepted ASCII signs, letters and signs beyond ASCII.
ASCII_OK = ".,;?!-()\"' "
WIDE_OK = "áéíóúÁÉÍÓÚâêîôûÂÊÎÔÛãõÃÕçÇàÀüÜ–—…°ªº§"
ASCII_SIGN = r"[\x00-\x7F&&[^\p{Alnum}\s\x0B.,;?!\-()\"']]"
FOREIGN = f"[^\\x00-\\x7F{WIDE_OK}]"
CONSONANTS = r"[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]+"
DIRTY, FOREIGN_SCORE, KEEP_PERCENT = 0.5, 7.0, 5


#: First line of the audit report.
REPORT_HEAD = "SCORE\tPATH\tISSUES"


def report_line(score: Column, path: Column, issues: Column) -> Column:
    """Score, path in quotes, issues as a bracketed list of quoted ones."""
    quoted = F.transform(issues, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.concat(fixed(score, 1), F.lit('\t"'), path, F.lit('"\t['), F.array_join(quoted, ", "), F.lit("]"))


def audit_line(df, line: str = "line"):
    """Adds score (null if not over DIRTY) and reason."""
    x = F.col(line)
    total = F.length(x).cast("double")
    df = df.withColumns({
        "density": (F.regexp_count(x, F.lit(ASCII_SIGN)) + 3 * F.regexp_count(x, F.lit(FOREIGN))) / total,
        "caps": F.regexp_count(x, F.lit("[A-Z]")) / total,
        "run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(x, F.lit(CONSONANTS), F.lit(0)), F.length)), F.lit(0)),
    })
    tests = [
        (F.col("density") > 0.15, F.col("density") * 3.0, F.concat(F.lit("High Symbol Density: "), fixed(F.col("density") * 100, 1), F.lit("%"))),
        ((F.col("caps") > 0.6) & (F.octet_length(x) > 50), F.lit(0.5), F.concat(F.lit("Caps Lock Abuse: "), fixed(F.col("caps") * 100, 1), F.lit("%"))),
        (F.contains(x, F.lit("\ufeff")) | F.contains(x, F.lit("\ufffd")), F.lit(1.0), F.lit("Ghost BOM / Replacement Char Detected")),
        (F.contains(x, F.lit("\\x")) | F.contains(x, F.lit("\\u")), F.lit(0.4), F.lit("Potential Malformed Escape Sequence")),
        (F.col("run") >= 5, F.lit(0.8), F.concat(F.lit("Impossible Consonant Cluster (len="), F.col("run").cast("string"), F.lit(")"))),
    ]
    raw = F.round(sum((F.when(c, s).otherwise(0.0) for c, s, _ in tests[1:]), F.when(tests[0][0], tests[0][1]).otherwise(0.0)), 6)
    df = df.withColumn("raw", raw).withColumn("why", F.concat_ws(" | ", *[F.when(c, r) for c, _, r in tests]))
    return df.withColumns({"score": F.when(F.col("raw") > DIRTY, F.col("raw")), "reason": F.when(F.col("raw") > DIRTY, F.col("why"))}).drop("raw", "why", "density", "caps", "run")


def hash_percent(x: Column) -> Column:
    """0 to 99 from the content, the same on every engine."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % 100


def purge_decision(line: Column, score: Column, reason: Column) -> Column:
    garbage = reason.rlike("Ghost BOM|Malformed|Caps Lock Abuse")
    return (
        F.when(garbage, "garbage")
        .when((score > FOREIGN_SCORE) & (hash_percent(line) >= KEEP_PERCENT), "entropy")
        .otherwise("kept")
    )
