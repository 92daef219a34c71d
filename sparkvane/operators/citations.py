"""Checking answers against the lines that were shown: citations, identifiers, uncited answers, claims of charts."""
from pyspark.sql import functions as F

from .retrieval import split_lines

# Forms of a citation, of an identifier, and of a claim that a chart is shown.
_RANGE = r"L?\d+(?:\s*[-–]\s*L?\d+)?"
CITATION = r"\[([^\[\]\n]{1,300}?):(L\d+(?:\s*[-–]\s*L?\d+)?(?:\s*,\s*" + _RANGE + r")*)\]"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_.]*(\(\))?$"
VISUAL = (
    r"(?i)\b(?:chart|plot|graph|figure|histogram|visuali[sz]ation)s?\b[^.\n]{0,60}\b(?:is |are |has been |have been )?"
    r"(?:shown|displayed|below|above|attached|generated|created)\b|\bsee (?:the )?(?:chart|plot|graph|figure)")
NEGATED = r"(?i)\b(?:not|cannot|can't|couldn't|n't|if you|want|would)\b"
FENCE = r"(?s)```.*?```"
SNIPPET_LINES, CLAIM_CHARS = 12, 200
# First characters that names are looked up by; characters of a window of a long run and the step between windows, which overlap by more than an identifier's 80.
SEED, WINDOW, STEP = 6, 1000, 900


def extract(answers):
    """(answer_id, raw, ref, start, end): each cited range; reversed ends are swapped. Null texts cite nothing."""
    x = answers.where("text is not null").select("answer_id", F.explode(F.regexp_extract_all("text", F.lit(f"({CITATION})"), F.lit(1))).alias("raw"))
    x = x.select("answer_id", "raw", F.trim(F.regexp_extract("raw", CITATION, 1)).alias("ref"), F.regexp_extract("raw", CITATION, 2).alias("spec"))
    x = x.select("answer_id", "raw", "ref", F.explode(F.split("spec", ",")).alias("part"))
    n = F.transform(F.regexp_extract_all("part", F.lit(r"(\d+)"), F.lit(1)), lambda v: v.cast("bigint"))
    a, b = F.element_at(n, 1), F.element_at(n, -1)
    return x.where(F.size(n) > 0).select("answer_id", "raw", "ref", F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))


def resolve(refs, files):
    """(ref, source, rel) of the single file each reference means: its path, then its path without case, then a path end, then a file
    name; `source:path`, `source::path` and `source/path` name the source. A rank with several files resolves to none.

    References join on the file name first, so only files of that name are compared."""
    base = F.lower(F.element_at(F.split(F.regexp_replace("ref", "::?", "/"), "/"), -1))
    r = refs.select("ref").distinct().withColumn("_b", base)
    f = files.where("text is not null").select("source", "rel").distinct().withColumn("_b", F.lower(F.element_at(F.split("rel", "/"), -1)))
    j = r.join(f, "_b")
    ref, rel, full = F.lower("ref"), F.lower("rel"), F.concat_ws("/", F.lower("source"), F.lower("rel"))
    plain = F.regexp_replace(ref, "::?", "/")
    rank = (
        F.when((F.col("ref") == F.col("rel")) | (plain == full), 1).when(ref == rel, 2)
        .when(F.endswith(rel, F.concat(F.lit("/"), plain)) | F.endswith(full, F.concat(F.lit("/"), plain)), 3).when(~F.contains(plain, F.lit("/")), 4))
    j = j.withColumn("_k", rank).where("_k is not null")
    best = j.groupBy("ref").agg(F.min("_k").alias("_k"))
    g = j.join(best, ["ref", "_k"]).groupBy("ref").agg(F.count("*").alias("_n"), F.min(F.struct("source", "rel")).alias("x"))
    return g.where("_n = 1").select("ref", "x.source", "x.rel")


def check(citations, files, evidence):
    """Each citation with status ok, not_read, bad_range or unknown_file, a detail and a snippet of up to twelve lines.

    Evidence is (source, rel, line); cited lines are counted by an equality join on exploded ranges that lie within the file."""
    one = citations.join(resolve(citations, files), "ref", "left")
    f = files.where("text is not null").select("source", "rel", split_lines(F.col("text")).alias("ls")).dropDuplicates(["source", "rel"])
    x = one.join(f, ["source", "rel"], "left").withColumn("n", F.size("ls"))
    inside = x.where("source is not null and start >= 1 and end <= n")
    cited = inside.select("source", "rel", "start", "end").distinct().withColumn("line", F.explode(F.sequence("start", "end")))
    seen = cited.join(evidence.select("source", "rel", F.col("line").cast("bigint").alias("line")).distinct(), ["source", "rel", "line"]).groupBy("source", "rel", "start", "end").agg(F.count("*").alias("seen"))
    x = x.join(seen, ["source", "rel", "start", "end"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    span = F.col("end") - F.col("start") + 1
    status = (
        F.when(F.col("source").isNull(), "unknown_file").when((F.col("start") < 1) | (F.col("end") > F.col("n")), "bad_range").when(F.col("seen") == 0, "not_read")
        .when(F.col("seen") < F.greatest(F.lit(1), F.floor(span / 2)), "not_read").otherwise("ok"))
    x = x.withColumn("status", status)
    detail = (
        F.when(F.col("status") == "bad_range", F.concat(F.col("rel"), F.lit(" has "), F.col("n"), F.lit(" lines")))
        .when((F.col("status") == "not_read") & (F.col("seen") == 0), "these lines were never shown")
        .when(F.col("status") == "not_read", F.concat(F.lit("only "), F.col("seen"), F.lit(" of "), span, F.lit(" cited lines were shown")))
        .when(F.col("status") == "unknown_file", "no single file answers to this reference").otherwise(""))
    ok = F.col("status").isin("ok", "not_read")
    snippet = F.when(ok, F.array_join(F.transform(F.sequence(F.col("start"), F.least(F.col("end"), F.col("start") + SNIPPET_LINES - 1)), lambda i: F.concat(i.cast("string"), F.lit("| "), F.element_at("ls", i.cast("int")))), "\n"))
    return x.select("answer_id", "raw", "ref", "start", "end", "status", detail.alias("detail"), "source", "rel", snippet.alias("snippet"))


def report(checked):
    """One row per cited range of a file, repeats dropped."""
    return checked.dropDuplicates(["answer_id", "source", "rel", "start", "end"])


def contained(terms, texts):
    """(term) of the distinct names that occur anywhere in a text, as parts of words too.

    A name lies within a run of name characters. The texts' distinct runs are cut into pieces of SEED characters that join the names on
    their first SEED; shorter names equal a piece of their own length. No text is paired with all names."""
    runs = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.]+"), F.lit(0)))).alias("run"))
    runs = runs.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("run"), F.lit(STEP)), lambda i: F.substring(F.col("run"), i, F.lit(WINDOW)))).alias("run")).distinct()

    def pieces(n):
        return F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, n))

    short = runs.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(SEED - 1), F.length("run"))), pieces))).alias("term")).distinct()
    seeds = runs.where(F.length("run") >= SEED).select("run", F.explode(F.array_distinct(pieces(F.lit(SEED)))).alias("seed"))
    long = terms.where(F.length("term") >= SEED).withColumn("seed", F.substring("term", 1, SEED))
    long = long.join(seeds, "seed").where(F.contains("run", F.col("term"))).select("term").distinct()
    return terms.where(F.length("term") < SEED).join(short, "term", "left_semi").unionByName(long)


def identifiers(answers, checked, files, evidence, allowed=()):
    """(answer_id, identifier): back-ticked names in a paragraph with a resolved citation that no file cited there or read contains.

    Names of files and sources are known, and so are those in `allowed`, such as the columns of loaded tables."""
    text = F.regexp_replace("text", FENCE, "")
    para = answers.where("text is not null").select("answer_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("p", "para"))
    names = para.select("answer_id", "p", "para", F.explode(F.regexp_extract_all("para", F.lit(r"`([^`\n]{3,80})`"), F.lit(1))).alias("identifier"))
    names = names.withColumn("identifier", F.trim("identifier")).where(F.col("identifier").rlike(IDENTIFIER))
    known = files.select(F.col("rel").alias("identifier")).union(files.select(F.element_at(F.split("rel", "/"), -1))).union(files.select("source")).distinct()
    names = names.join(known, "identifier", "left_anti")
    if allowed:
        names = names.where(~F.col("identifier").isin(list(allowed)))
    good = checked.where("source is not null").select("answer_id", "raw", "source", "rel").distinct()
    cited = names.join(good, "answer_id").where(F.contains("para", F.col("raw"))).select("answer_id", "p", "identifier", "source", "rel")
    read = names.join(good, "answer_id").where(F.contains("para", F.col("raw"))).select("answer_id", "p", "identifier").distinct()
    bare = F.regexp_replace("identifier", r"\(\)$", "")
    last = F.element_at(F.split(bare, r"\."), -1)
    texts = files.where("text is not null").select("source", "rel", "text").dropDuplicates(["source", "rel"])
    hit = cited.distinct().join(texts, ["source", "rel"]).where(F.contains("text", bare) | F.contains("text", last)).select("answer_id", "p", "identifier").distinct()
    shown = texts.join(evidence.select("source", "rel").distinct(), ["source", "rel"], "left_semi")
    terms = names.select("identifier").distinct().select("identifier", F.explode(F.array(bare, last)).alias("term"))
    there = terms.join(contained(terms.select("term").distinct(), shown), "term").select("identifier").distinct()
    read = read.join(there, "identifier", "left_anti")
    return read.join(hit, ["answer_id", "p", "identifier"], "left_anti").select("answer_id", "identifier").distinct()


def uncited(answers, citations):
    """(answer_id) of grounded answers of some length without a citation that do not say they are general knowledge."""
    claims = F.length(F.regexp_replace("text", FENCE, "")) > CLAIM_CHARS
    general = F.startswith(F.lower(F.regexp_replace("text", r"^[*_# ]+", "")), F.lit("general knowledge"))
    return answers.where(F.col("grounded") & claims & ~general).join(citations.select("answer_id").distinct(), "answer_id", "left_anti").select("answer_id")


def visual_claims(answers):
    """(answer_id, claim): sentences that say a chart is shown, without a negation, in answers that have no visual artifact."""
    x = answers.where(~F.col("has_visual") & F.col("text").isNotNull()).select("answer_id", F.explode(F.regexp_extract_all("text", F.lit(f"({VISUAL})"), F.lit(1))).alias("claim"))
    return x.where(~F.col("claim").rlike(NEGATED))
