"""String functions of the engine as Column expressions: shingles, tokens, ids, prompts, parsing."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.functions.text import normalize_native, words_native

GRAM_WORDS = 5
THINK = "think"


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and blank strings."""
    return F.when(F.trim(c) != "", c)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, also where f uses it inside higher-order functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_grams(words: Column, n: int = GRAM_WORDS) -> Column:
    """Runs of ``n`` words, repeated ones too; an empty array for fewer words."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def _char_grams(flat: Column) -> Column:
    width = F.least(F.lit(8), F.greatest(F.lit(3), F.length(flat)))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - width + 1, F.lit(1))), lambda i: F.substr(flat, i, width))


def grams(c: Column) -> Column:
    """Word 5-grams, or for shorter texts character grams of the text without spaces (B2), repeated ones too.

    A text without words has the single gram ''; null has null. Sets of them are best made of their hashes, since
    distinct strings of an array are found by comparing all with all.
    """
    return F.when(c.isNull(), None).otherwise(_grams_of(words_native(c)))


def _grams_of(words: Column) -> Column:
    both = lambda w: F.when(F.size(w) >= GRAM_WORDS, word_grams(w)).otherwise(let(F.array_join(w, ""), _char_grams))
    return let(words, both)


def normalized_grams(n: Column) -> Column:
    """The grams of a text that is normalised already, in whichever form."""
    return F.when(n.isNull(), None).otherwise(_grams_of(F.filter(F.split(n, " "), lambda w: w != "")))


def gram_set(c: Column) -> Column:
    """The distinct grams as 64-bit hashes."""
    return _hashed(grams(c))


def normalized_gram_set(n: Column) -> Column:
    """The result of :func:`gram_set` for a text that is normalised already."""
    return _hashed(normalized_grams(n))


def _hashed(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda g: F.xxhash64(g)))


def tokens(c: Column) -> Column:
    """Lower-cased runs free of punctuation, as the sparse retrievers see them."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def skill_text(name: Column, description: Column, content: Column) -> Column:
    """Non-empty name, description and content, one under the other."""
    return F.concat_ws("\n", *(F.when(x != "", x) for x in (name, description, content)))


def display_name(name: Column, index: Column | None = None) -> Column:
    """Trimmed name, else a numbered or nameless stand-in; never the id."""
    stand_in = F.lit("Unnamed skill") if index is None else F.concat(F.lit("Skill #"), index.cast("string"))
    return F.coalesce(blank_to_null(F.trim(name)), stand_in)


def dataset_of(skill_id: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_replace(skill_id, "_[^_]*$", "")


def short_hash(*parts: Column, prefix: str = "", length: int = 20) -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of the parts, joined by a zero byte."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length))


def stable_seed(seed: int, key: Column) -> Column:
    """First eight bytes of SHA-256 of "seed:key" as an unsigned number in a string."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10)


def fingerprint(pairs: Column) -> Column:
    """SHA-256 of sorted strings, so that the order of rows doesn't matter."""
    return F.sha2(F.array_join(F.sort_array(pairs), "\n"), 256)


def strip_think(c: Column) -> Column:
    """Without closed think blocks and what follows them in white space, nor an unclosed tail."""
    closed = F.regexp_replace(c, rf"(?s)<{THINK}>.*?</{THINK}>\s*", "")
    return F.regexp_replace(F.regexp_replace(closed, rf"(?s)<{THINK}>.*$", ""), r"^\s+", "")


def truncate(c: Column, n: int, suffix: str = "") -> Column:
    """The first ``n`` characters, with a suffix if something was cut off."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def model_short_name(c: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(c, "/"), -1)


def retrieval_label(model: Column, reranker: Column) -> Column:
    """Model name, marked if a reranker follows."""
    return F.concat(model_short_name(model), F.when(blank_to_null(reranker).isNotNull(), "_rerank").otherwise(""))


def scope_label(ids: Column) -> Column:
    """One id itself, else a short hash of the sorted ids."""
    many = F.concat(F.lit("skills-"), F.substring(F.sha2(F.array_join(F.sort_array(ids), "\n"), 256), 1, 12))
    return F.when(F.size(ids) == 1, F.element_at(ids, 1)).otherwise(many)


def with_skills(user: Column, skills: Column) -> Column:
    """The user prompt with the skills before it, if there are any."""
    block = F.concat(F.lit("Relevant Skill:\n"), F.array_join(skills, "\n---\n"), F.lit("\n\n"), user)
    return F.when(F.size(skills) > 0, block).otherwise(user)


def without_skills(user: Column) -> Column:
    """The user prompt without the first skill block."""
    start = F.locate("Relevant Skill:\n", user)
    stop = F.locate("\n\n", user, 1)
    rest = F.substr(user, stop + 2)
    return F.when((start == 1) & (stop > 0), rest).otherwise(user)


def without_known_skills(user: Column, skills: Column) -> Column:
    """The user prompt without the first block of these skills, wherever it stands and whatever they hold."""
    block = F.concat(F.lit("Relevant Skill:\n"), F.array_join(skills, "\n---\n"), F.lit("\n\n"))
    at = F.locate("Relevant Skill:\n", user)  # cheap sign that there is any
    start = F.when(at > 0, F.position(block, user)).otherwise(0)
    rest = F.concat(F.substr(user, F.lit(1), start - 1), F.substr(user, start + F.length(block)))
    return F.when((F.size(skills) > 0) & (start > 0), rest).otherwise(user)


def catalog_lines(names: Column, descriptions: Column) -> Column:
    """One line "[i] name: description" an entry, counted from 1."""
    pair = F.arrays_zip(names.alias("n"), descriptions.alias("d"))
    return F.array_join(F.transform(pair, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["n"], F.lit(": "), F.coalesce(x["d"], F.lit("")))), "\n")


def parse_action(c: Column) -> Column:
    """struct(kind, argument) of "Kind[argument]"; null fields for anything else."""
    pattern = r"(?s)^(\w+)\[(.+)\]$"
    hit = F.trim(c).rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(F.trim(c), pattern, 1)).alias("kind"), F.when(hit, F.regexp_extract(F.trim(c), pattern, 2)).alias("argument"))


def parse_ranking(c: Column, n: int) -> Column:
    """0-based distinct places named in a text, in order of their first mention, those in range."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("int"))
    return F.transform(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n))), lambda x: x - 1)


def number_signature(c: Column) -> Column:
    """The numbers of the normalised text, in order (B23); its dots are gone by then."""
    return F.regexp_extract_all(normalize_native(c), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


# Build of a phrase that counts as a name, and the keyword of a text without one.
PHRASE = r"\b[A-Z][A-Za-z]+(?:[ \t\r\n\f-][A-Za-z0-9]+){0,3}\b"
NO_KEYWORD = "neural network"


def keyword(c: Column, stop: list[str], head: int = 400, least: int = 4) -> Column:
    """First phrase that begins with a capital, is long enough and doesn't begin with a stop word.

    Up to three words may follow the first, in any case or with digits. Without a phrase, as in a null or empty
    text, it is the general keyword.
    """
    # letters beyond ASCII are letters of a word, but of no phrase; marks that combine are neither
    plain = F.regexp_replace(F.regexp_replace(F.substring(c, 1, head), r"\p{M}", "."), r"[\p{L}\p{N}&&[^A-Za-z0-9]]", "_")
    phrases = F.regexp_extract_all(plain, F.lit(PHRASE), F.lit(0))
    first = lambda p: F.lower(F.regexp_extract(p, r"^[^ \t\r\n\f]+", 0))
    good = F.filter(phrases, lambda p: (F.length(p) >= least) & ~first(p).isin(stop))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(NO_KEYWORD))


def flatten_list(c: Column) -> Column:
    """Elements split at commas, trimmed, without empty ones, distinct in order."""
    parts = F.flatten(F.transform(c, lambda x: F.split(x, ",")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


# -- what built-in expressions can't do: Arrow-batched Python --------------------------------------


def _balanced(text: str) -> str | None:
    """The first balanced {...} or [...] of a text that is JSON."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            value, _ = decoder.raw_decode(text, m.start())
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def json_of(text: str | None) -> str | None:
    """JSON out of prose: a fenced block, the whole text, or the first value inside it."""
    if not text:
        return None
    for part in [*re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.S), text]:
        try:
            return json.dumps(json.loads(part), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return _balanced(text)


@F.pandas_udf(StringType())
def json_from_prose(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of :func:`json_of`; keys sorted, null where there is no JSON."""
    for s in texts:
        yield s.map(json_of)


_CALL = re.compile(r"^[ \t]*TOOL_CALL:[ \t]*(\w+)\((.*)\)[ \t]*$", re.M)


def tool_call_of(text: str | None, known: dict[str, list[str]]) -> str | None:
    """The first call of a known tool in a text as JSON {name, args}; literals only, never evaluated."""
    for m in _CALL.finditer(text or ""):
        names = known.get(m.group(1))
        if names is None:
            continue
        try:
            call = ast.parse(f"f({m.group(2)})", mode="eval").body
            args = {names[i] if i < len(names) else f"_pos_{i}": ast.literal_eval(a) for i, a in enumerate(call.args)}
            args |= {k.arg: ast.literal_eval(k.value) for k in call.keywords}
            return json.dumps({"name": m.group(1), "args": args}, sort_keys=True, default=str)
        except (SyntaxError, ValueError, TypeError):
            continue
    return None


_MARK = r"[ \t]*(?:Thought|Action|Observation)[ \t]*\d*[ \t]*:"


THOUGHT_CHARS = 4000  # fixed value: characters of a thought that are kept


def react_step(text: str | None, step: int) -> tuple[str, str]:
    """(thought, action) of a reply in steps.

    Think blocks are dropped and the text ends at an observation of its own making; the action of the given
    step counts, else the first action; an action may run over lines up to the next mark.
    """
    t = re.sub(r"<think>.*?</think>\s*", "", text or "", flags=re.S)
    t = re.sub(r"<think>.*\Z", "", t, flags=re.S).strip()
    t = re.split(r"\n\s*Observation\s*\d*\s*:", t, maxsplit=1)[0].rstrip()
    hits = list(re.finditer(r"^[ \t]*Action[ \t]*(\d*)[ \t]*:[ \t]*", t, re.M))
    mark = next((m for m in hits if m.group(1) == str(step)), hits[0] if hits else None)
    thought = re.sub(r"^Thought[ \t]*\d*[ \t]*:[ \t]*", "", (t[: mark.start()] if mark else t).strip()).strip().replace("\n", " ")
    action = re.split(rf"\n{_MARK}", t[mark.end() :].strip(), maxsplit=1)[0].rstrip() if mark else ""
    return (thought[:THOUGHT_CHARS] + "..." if len(thought) > THOUGHT_CHARS else thought), action
