"""Text functions: normal forms, tokens, shingles, similarity, rule chains. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the token form.
STOP_WORDS = (
    "a an the of to for in on at with and or is are do does my your "
    "me i you it this that from by as be"
).split()


def normalize(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and space to space, runs of spaces to one. ASCII only: accented
    letters go."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def tokens(text: Column) -> Column:
    """Words of the normal form without stop words; an empty array for none."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(normalize(text), " "), lambda t: (t != "") & ~F.array_contains(stop, t))


def token_set(text: Column) -> Column:
    """The distinct tokens, by one hashed set difference."""
    return F.array_except(F.split(normalize(text), " "), F.array(*[F.lit(w) for w in ["", *STOP_WORDS]]))


def shingles(words: Column, k: int) -> Column:
    """All runs of k words, space-joined; a shorter text is one run; none for no words. The words are bound
    once (as the element of a one-element array): inside the inner function they would be computed anew for
    each run."""

    def runs(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        return F.transform(places, lambda i: F.array_join(F.slice(w, i, k), " "))

    bound = F.get(F.transform(F.array(words), runs), F.lit(0))
    return F.when(F.size(words) > 0, bound).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def token_hash(seed: int, token: Column) -> Column:
    """The first 16 hex digits of md5 of 'seed|token'; equal widths, so text order is numeric order."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|"), token)), 1, 16)


def standardize(value: Column) -> Column:
    """Without ` ,./-_*^`, lower case, single quotes as double ones."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, "[ ,./\\-_*^]", "")), "'", '"')


def collapse(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, "\\s+", " ")))


def contains_value(blob: Column, value: Column) -> Column:
    """Whether the normalized value occurs in the normalized blob."""
    return F.contains(collapse(blob), collapse(value))


def loose_match(a: Column, b: Column) -> Column:
    """Either stripped value within the other."""
    x, y = F.trim(a), F.trim(b)
    return F.contains(x, y) | F.contains(y, x)


def slug(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9]", "_")


def escape_lines(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def object_noun(value: Column, verbs: list[str]) -> Column:
    """The first two words that are no verb."""
    listed = F.array(*[F.lit(v) for v in verbs])
    return F.array_join(F.slice(F.filter(F.split(value, "[._\\-: ]+"), lambda t: (t != "") & ~F.array_contains(listed, t)), 1, 2), " ")


def first_match(value: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The result of the first rule (regex, result) that matches."""
    out = None
    for pattern, result in rules:
        out = F.when(value.rlike(pattern), F.lit(result)) if out is None else out.when(value.rlike(pattern), F.lit(result))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def fenced_blocks(text: Column) -> Column:
    """Contents of ``` blocks."""
    return F.regexp_extract_all(text, F.lit("(?s)```[a-z]*\\n?(.*?)```"), F.lit(1))


def react_calls(text: Column) -> Column:
    """(tool, input) pairs of 'Action: x / Action Input: y' text."""
    names = F.regexp_extract_all(text, F.lit("Action:[ ]*([^\\n]+)"), F.lit(1))
    inputs = F.regexp_extract_all(text, F.lit("Action Input:[ ]*([^\\n]+)"), F.lit(1))
    return F.arrays_zip(names.alias("tool"), inputs.alias("input"))


def tagged(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def merge_arguments(curated: Column, raw: Column, limit: int = 200) -> Column:
    """Maps of strings: curated keys win, raw ones are added, values cut to ``limit`` characters."""
    fresh = F.map_filter(raw, lambda k, v: ~F.map_contains_key(curated, k) & v.isNotNull())
    return F.map_concat(F.transform_values(fresh, lambda k, v: F.left(v, F.lit(limit))), curated)


def sql_features(sql: Column) -> dict[str, Column]:
    """Boolean columns for the clauses of a SQL text."""
    found = {
        "has_where": "\\bwhere\\b",
        "has_group": "\\bgroup\\s+by\\b",
        "has_having": "\\bhaving\\b",
        "has_order": "\\border\\s+by\\b",
        "has_limit": "\\blimit\\b",
        "has_join": "\\bjoin\\b",
        "has_aggregate": "\\b(count|sum|avg|min|max)\\s*\\(",
        "has_distinct": "\\bdistinct\\b",
    }
    return {name: F.lower(sql).rlike(pattern) for name, pattern in found.items()}


def dependency_level(value: Column, user_text: Column) -> Column:
    """0: in the user's text; 1: a plain literal; 2: looks like a generated id, number, address or URL."""
    generated = (
        value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")
        | value.rlike("^[A-Za-z]*[_#-]?[0-9]{3,}$")
        | value.rlike("^[^@ ]+@[^@ ]+$")
        | value.rlike("^https?://")
    )
    return F.when(F.contains(F.lower(user_text), F.lower(value)), 0).when(generated, 2).otherwise(1)


def format_difference(a: Column, b: Column) -> Column:
    """'same', 'format' (same digits or same letters once all else goes) or 'different'."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    alike = ((digits(a) != "") & (digits(a) == digits(b))) | ((letters(a) != "") & (letters(a) == letters(b)))
    return F.when(a == b, "same").when(alike, "format").otherwise("different")


def path_terminal(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def fingerprint(*columns: str, digits: int = 16) -> Column:
    return F.left(F.sha2(F.to_json(F.struct(*columns)), 256), F.lit(digits))


# Fixed values: (pattern in the instruction, operations that meet it, texts in a payload that meet it, what is missing).
INTENTS = (
    (r"\b(cheapest|lowest price|lowest cost|minimum price|least expensive)\b", ("ARGMIN", "MIN"), ("min(", "order by"), "optimization(min)"),
    (r"\b(most expensive|highest price|maximum|largest|highest)\b", ("ARGMAX", "MAX"), ("max(",), "optimization(max)"),
    (r"\b(send|email|e-?mail)\b", ("SEND",), (), "send"),
    (r"\btranslate\b", ("TRANSLATE",), ("translate",), "translate"),
    (r"\bsummar(ize|y|ise)\b", ("SUMMARIZE",), ("summar",), "summarize"),
    (r"\bsort(ed|ing)?\b", ("SORT",), ("order by",), "sort"),
    (r"\b(how many|count the|number of)\b", ("COUNT", "SUM"), ("count(",), "count"),
    (r"\b(average|mean of|avg)\b", ("AVG", "CALCULATE"), ("avg(", "average("), "average"),
)


def missing_constraints(instruction: Column, ops: Column, payload: Column | None = None) -> Column:
    """What an instruction asks for in words and a plan (its operations, and a payload such as SQL) does not do."""
    low, data = F.lower(F.coalesce(instruction, F.lit(""))), F.lower(F.coalesce(payload if payload is not None else F.lit(""), F.lit("")))
    found = []
    for pattern, equal, texts, name in INTENTS:
        met = F.coalesce(F.arrays_overlap(ops, F.array(*[F.lit(o) for o in equal])), F.lit(False))
        for text in texts:
            met = met | F.contains(data, F.lit(text))
        found.append(F.when(low.rlike(pattern) & ~met, F.lit(f"MISSING_CONSTRAINT:{name}")))
    return F.array_compact(F.array(*found))


def accepted(value: Column, alternatives: Column) -> Column:
    """Whether a value (text, null: not given) is one of the accepted ones: equal once standardized or as numbers; an empty
    text among them makes the value optional."""
    number = lambda c: c.try_cast("double")
    equal = F.exists(alternatives, lambda a: (standardize(a) == standardize(value)) | F.coalesce(number(a) == number(value), F.lit(False)))
    return F.when(value.isNull(), F.array_contains(alternatives, "")).otherwise(F.coalesce(equal, F.lit(False)))
