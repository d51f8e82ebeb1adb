"""String functions of the engine as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Language by file extension.
LANGUAGES = {
    "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "py": "python", "go": "go", "yaml": "config", "yml": "config", "toml": "config", "json": "config",
}
#: Words that are never taken for a reference.
STOP_WORDS = (
    "self this type fn let const class struct enum trait impl pub mod use for while loop if else match return async await true false null None Some Ok Err "
    "package import export public private protected static final abstract override void int String string bool float double "
    "name kind id file run new get set add from into clone default size len format path value index data result error test tests main args self_"
).split()


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x) -> Column:
    return F.translate(_c(x), ASCII, ASCII.lower())


def enum_literal(x) -> Column:
    """Letters and digits alone, ASCII-lowered."""
    return ascii_lower(F.regexp_replace(_c(x), r"[^\p{L}\p{N}]", ""))


def local_name(x) -> Column:
    return F.substring_index(_c(x), ".", -1)


def parent_name(x) -> Column:
    return F.regexp_extract(_c(x), r"^(.*)\.[^.]*$", 1)


def config_key(x) -> Column:
    return F.lower(F.translate(_c(x), "._-", ""))


def segments(x) -> Column:
    return F.filter(F.split(_c(x), "/"), lambda s: s != "")


def segment_count(x) -> Column:
    return F.size(segments(x))


def version_only(a, b) -> Column:
    """Whether two paths differ in one segment only, by versions like v1 and v2."""
    x, y = F.split(_c(a), "/"), F.split(_c(b), "/")
    differs = F.filter(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda v: ~v["p"].eqNullSafe(v["q"]))
    one = F.get(differs, F.lit(0))
    return (F.size(x) == F.size(y)) & (F.size(differs) == 1) & F.coalesce(one["p"].rlike("^v[0-9]+$") & one["q"].rlike("^v[0-9]+$"), F.lit(False))


def extension(file) -> Column:
    return F.regexp_extract(_c(file), r"\.([^./]+)$", 1)


def language(file) -> Column:
    """By extension, case aside."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(extension(file))), F.lit("unknown"))


def file_stem(file) -> Column:
    name = F.element_at(F.split(_c(file), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def folder_of(file) -> Column:
    """What stands before the last slash; empty for files of the root."""
    return F.regexp_extract(_c(file), "^(.*)/[^/]*$", 1)


def module_of(file) -> Column:
    """The segment after ``crates`` or before ``src``, whichever of them comes first; else the file's stem."""
    p = F.split(_c(file), "/")
    named = F.transform(p, lambda s, i: F.when((s == "crates") & (i + 1 < F.size(p)), F.get(p, i + 1)).when((s == "src") & (i >= 1), F.get(p, i - 1)))
    return F.coalesce(F.get(F.array_compact(named), F.lit(0)), F.when(file_stem(file) != "", file_stem(file)), F.lit("unknown"))


def is_public(name, visibility) -> Column:
    return F.when(_c(visibility) == "Public", True).when(_c(visibility) == "Private", False).otherwise(_c(name).rlike(r"^\p{L}"))


def is_test_path(file) -> Column:
    """A folder or file named test or tests, or a file name that tells of tests."""
    return _c(file).rlike(r"(^|/)tests?(/|$)|(_tests?\.rs|_test\.go|Tests?\.java|\.(test|spec)\.[jt]sx?|(^|/)test_[^/]*\.pyi?)$")


def tokens(x, least: int = 4) -> Column:
    """Sorted distinct words of letters, digits and underscores of ``least`` bytes or more, without stop words."""
    words = F.array_distinct(F.split(_c(x), r"[^\p{L}\p{N}_]+"))
    return F.array_sort(F.array_except(F.filter(words, lambda w: F.octet_length(w) >= least), F.array(*[F.lit(w) for w in STOP_WORDS])))


def minified(content) -> Column:
    size = F.octet_length(_c(content))
    lines = F.greatest(F.size(F.split(_c(content), "\n", -1)) - F.when(_c(content).endswith("\n"), 1).otherwise(0), F.lit(1))
    return (size >= 4096) & (F.floor(size / lines) > 1000)


def estimated_tokens(x) -> Column:
    plain = F.regexp_count(_c(x), F.lit(r"[\x00-\x7F]"))
    return F.floor(plain / 4) + F.floor((F.length(_c(x)) - plain) / 2) + 1


def utf8_bytes(x) -> Column:
    """A text whose characters are the UTF-8 bytes of ``x``."""
    return F.decode(F.encode(_c(x), "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a, b, most: int | None = None) -> Column:
    """Edit distance over UTF-8 bytes; with ``most``, -1 beyond it."""
    return F.levenshtein(utf8_bytes(a), utf8_bytes(b)) if most is None else F.levenshtein(utf8_bytes(a), utf8_bytes(b), most)


def quoted(x) -> Column:
    return F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


#: Characters between words that stand for each other in a search, and those after which a word begins.
SEPARATORS = "_/.:- "
WORD_STARTS = "_/.:-"


def _begins(low: Column, plain: Column, at: Column) -> Column:
    """Whether a word begins at a place, from 1: at the start, after a separator, or at a capital after a small letter."""
    before, here = F.substring(plain, at - 1, F.lit(1)), F.substring(plain, at, F.lit(1))
    camel = (F.length(low) == F.length(plain)) & here.rlike("[A-Z]") & before.rlike("[a-z]")
    return (at == 1) | F.substring(low, at - 1, F.lit(1)).isin(list(WORD_STARTS)) | camel


def subsequence_score(query: str, text) -> Column:
    """How well a query fits a text of which it is a subsequence, case and kinds of separators aside; else null.

    A whole occurrence counts 100, 4 a character, more at the start, at a word's start and if it is all, less farther in.
    Characters apart count 4 where they follow each other, 3 at a word's start, and lose up to 3 for a gap.
    """
    one = str.maketrans(SEPARATORS, "_" * len(SEPARATORS))
    q, plain = query.lower().translate(one), _c(text)
    if not q:
        return F.lit(None).cast("double")
    low = F.lower(plain)
    flat = F.translate(low, SEPARATORS, "_" * len(SEPARATORS))
    at = F.instr(flat, q)
    whole = 100 + 4 * len(q) - (at - 1) * 0.5 + F.when(at == 1, 20).when(_begins(low, plain, at), 10).otherwise(0) + F.when(F.length(low) == len(q), 30).otherwise(0)
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("score"), F.lit(True).alias("ok"))

    def step(done, c):
        found = F.call_function("locate", c, flat, done["last"] + 1)
        gain = F.when((done["last"] > 0) & (found == done["last"] + 1), F.lit(4.0)).otherwise(F.least(found - done["last"] - 1, F.lit(12)) * -0.25)
        score = done["score"] + gain + F.when(_begins(low, plain, found), 3.0).otherwise(0.0)
        return F.struct(found.alias("last"), score.alias("score"), (done["ok"] & (found > 0)).alias("ok"))

    apart = F.aggregate(F.array(*[F.lit(c) for c in q]), start, step)
    return F.when(at > 0, whole.cast("double")).when(apart["ok"], apart["score"])


def search(nodes, query: str, limit: int = 50):
    """Nodes ``(id, name, file, degree)`` by how well a query fits their name, which counts twice, or file; well connected ones
    a little better."""
    by_name, by_file = 2 * subsequence_score(query.strip(), "name"), subsequence_score(query.strip(), "file")
    score = F.greatest(by_name, by_file) + F.least("degree", F.lit(40)) * 0.05
    return nodes.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), F.length("name"), "id").limit(limit)
