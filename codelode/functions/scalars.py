"""Column functions: Column (or its name) to Column, all evaluated in the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode import schemas as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, pairs: Mapping[str, str]) -> Column:
    """The value of c in a literal map, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), col(c))


# --- paths, names and languages -------------------------------------------------------------------


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The last suffix of a file name with its dot, or empty; a leading dot begins no suffix."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def language_of(path: Column | str) -> Column:
    """The language of a path by its suffix, case-sensitive; null for others."""
    return lookup(suffix(path), S.LANGUAGES)


def language_name(lang: Column | str) -> Column:
    """The name to show for a language."""
    c = col(lang)
    return F.coalesce(lookup(F.lower(c), S.LANGUAGE_NAMES), F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))))


def is_ignored(path: Column | str, dirs: Sequence[str] = S.IGNORED_DIRS) -> Column:
    """Whether a component of a relative path is an ignored directory."""
    return F.arrays_overlap(F.split(col(path), "/"), F.array(*map(F.lit, dirs)))


def is_text_file(path: Column | str) -> Column:
    name = file_name(path)
    return F.lower(suffix(path)).isin(*S.TEXT_SUFFIXES) | name.isin(*S.TEXT_NAMES)


def repo_dir(url: Column | str) -> Column:
    """The folder name of a repository's address: the last segment without .git, other characters than letters, digits, _ . - replaced."""
    last = F.element_at(F.split(F.regexp_replace(col(url), "/+$", ""), "/"), -1)
    return F.regexp_replace(F.regexp_replace(last, r"\.git$", ""), "[^a-zA-Z0-9_.-]", "_")


def path_safe(branch: Column | str) -> Column:
    return F.replace(col(branch), F.lit("/"), F.lit("_"))


def partition_name(repo_uuid: Column | str, directory: Column | str) -> Column:
    """The name of a directory's partition; at most 63 characters."""
    head, d = F.concat(F.lit("repo_"), F.substring(col(repo_uuid), 1, 8), F.lit("_")), col(directory)
    tail = F.btrim(F.regexp_replace(F.replace(F.lower(d), F.lit("/"), F.lit("_")), "[^a-z0-9_]+", "_"), F.lit("_"))
    return F.substring(F.when(d == ".", F.concat(head, F.lit("_root"))).otherwise(F.concat(head, tail)), 1, 63)


def listing_prefix(prefix: Column | str) -> Column:
    """A listing prefix in its normal form: forward slashes, no leading ./, a slash at the end; empty for the root."""
    p = F.regexp_replace(F.replace(F.coalesce(col(prefix), F.lit("")), F.lit("\\"), F.lit("/")), "^(\\./)+", "")
    return F.when(p.isin("", ".", "/"), F.lit("")).when(F.endswith(p, F.lit("/")), p).otherwise(F.concat(p, F.lit("/")))


def ancestors(path: Column | str) -> Column:
    """The directories that hold a path, the nearest first and the root (.) last."""
    parts = F.split(col(path), "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    return F.reverse(dirs)


def dir_depth(directory: Column | str) -> Column:
    """0 for the root, else the number of components."""
    d = col(directory)
    return F.when(d == ".", 0).otherwise(F.size(F.split(d, "/")))


# --- content --------------------------------------------------------------------------------------


def content_hash(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def line_count(text: Column | str) -> Column:
    """Lines of a text that end in \\n, and the last one if it isn't empty."""
    t = col(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((t != "") & ~F.endswith(t, F.lit("\n")), 1).otherwise(0)).cast("long")


def _without_white_space(text: Column) -> Column:
    return F.translate(text, " \t\n\r\f\x0b", "")


def word_count(text: Column | str) -> Column:
    """Runs without ASCII white space. Each becomes one letter, so no list of them is made."""
    return F.length(_without_white_space(F.regexp_replace(col(text), r"[^ \t\n\r\f\x0B]+", "w")))


def token_count(text: Column | str) -> Column:
    """The offline tokenizer: runs of letters, digits or _ (each becomes one letter), and every other character that isn't white space."""
    return F.length(_without_white_space(F.regexp_replace(col(text), "[A-Za-z0-9_]+", "w")))


def slice_content(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """content[start:end] by characters, or null where not 0 <= start <= end <= length."""
    c, s, e = col(content), col(start), col(end)
    return F.when((s >= 0) & (s <= e) & (e <= F.length(c)), F.substring(c, s + 1, e - s))


def line_snippet(content: Column | str, first: Column | str, last: Column | str) -> Column:
    """Lines first to last (from 1, both included) with their line ends; a note where an argument is null."""
    c, a, b = col(content), col(first), col(last)
    lines = F.split(c, "\n")
    a = F.greatest(a, F.lit(1))
    part = F.slice(lines, a, F.greatest(b - a + 1, F.lit(0)))
    end = F.when(b < F.size(lines), "\n").otherwise("")
    return F.when(c.isNull() | col(first).isNull() | b.isNull(), F.lit(S.NO_DATA)).when(a > F.size(lines), "").otherwise(F.concat(F.array_join(part, "\n"), F.when(b >= a, end).otherwise("")))


def snippet(text: Column | str, lines: int = 3, chars: int = 150) -> Column:
    """The first lines of a text; cut at the last space before chars with "...", or with a line "..." if lines follow."""
    t = col(text)
    all_lines = F.split(t, "\n")
    head = F.array_join(F.slice(all_lines, 1, lines), "\n")
    cut = F.substring(head, 1, chars)
    at_space = F.regexp_replace(cut, r"(?s) [^ ]*$", "")
    return F.when(F.length(head) > chars, F.concat(at_space, F.lit("..."))).when(F.size(all_lines) > lines, F.concat(head, F.lit("\n..."))).otherwise(head)


def truncated(text: Column | str, most: int = S.MAX_OUTPUT_CHARS) -> Column:
    t = col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(S.TRUNCATED))).otherwise(t)


def last_segment(name: Column | str) -> Column:
    """What follows the last dot of a called name."""
    return F.element_at(F.split(col(name), r"\."), -1)


def contains_any(text: Column | str, words: Sequence[str]) -> Column:
    """Whether a text holds any of the words, whatever their case; false for no words. Words are stripped; empty ones don't count."""
    wanted = [w.strip().lower() for w in words if w.strip()]
    low = F.lower(col(text))
    out = F.lit(False)
    for w in wanted:
        out = out | F.contains(low, F.lit(w))
    return out


def replace_lines(content: Column | str, first: int, last: int, new: str) -> Column:
    """A text whose lines first to last (from 1) are replaced; unchanged where the range isn't inside it."""
    c = col(content)
    lines = F.split(c, "\n")
    n = F.size(lines)
    before, after = F.slice(lines, 1, first - 1), F.slice(lines, last + 1, F.greatest(n - last, F.lit(0)))
    return F.when((n >= last) & F.lit(1 <= first <= last), F.array_join(F.concat(before, F.array(F.lit(new)), after), "\n")).otherwise(c)


def find_replace(content: Column | str, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col(content), pattern, replacement)


# --- scores and costs -----------------------------------------------------------------------------


def complexity(types: Column | str, language: Column | str) -> Column:
    """1 and the number of a node's descendants (itself included) that count in its language."""
    sets = F.create_map(*[x for k, v in S.COMPLEXITY_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    counted = F.coalesce(F.element_at(sets, col(language)), F.array().cast("array<string>"))
    return 1 + F.size(F.filter(col(types), lambda t: F.array_contains(counted, t)))


def importance(node_type: Column | str, has_docstring: Column | str, complexity: Column | str, tokens: Column | str) -> Column:
    t, w = col(node_type), S.IMPORTANCE
    kind = F.when(t.endswith("class_definition") | t.endswith("class_declaration"), w["class"]).when(t.contains("function") | t.contains("method"), w["function"]).otherwise(0.0)
    doc = F.when(col(has_docstring), w["docstring"]).otherwise(0.0)
    hard = F.when(col(complexity) > w["complex_above"], w["complex"]).otherwise(0.0)
    size = F.when(col(tokens) < w["short_below"], w["short"]).when(col(tokens) > w["long_above"], w["long"]).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(w["base"]) + kind + doc + hard + size))


def partition_cost(files: Column | str, target: int = S.TARGET_FILES) -> Column:
    n = col(files)
    return F.when(n > target, (n - target) * S.OVER_TARGET_COST).otherwise((target - n).cast("double"))


def llm_cost(prompt: Column | str, completion: Column | str, input_price: Column | float, output_price: Column | float) -> Column:
    return col(prompt) / 1e6 * input_price + col(completion) / 1e6 * output_price


def estimated_tokens(text: Column | str) -> Column:
    """The whole part of 1.3 tokens a word, in whole numbers."""
    return F.floor(word_count(text) * 13 / 10).cast("long")


# --- display --------------------------------------------------------------------------------------


def format_bytes(n: Column | str) -> Column:
    v = col(n).cast("double")
    unit = lambda k, u: F.concat(two_places(v / k), F.lit(u))
    return F.when(v < 1024, F.concat(col(n).cast("long").cast("string"), F.lit(" B"))).when(v < 1024**2, unit(1024, " KB")).when(v < 1024**3, unit(1024**2, " MB")).otherwise(unit(1024**3, " GB"))


def duration(seconds: Column | str) -> Column:
    """[Nh ][Nm ]Ns: minutes also where there are hours; negative counts as 0."""
    s = F.greatest(F.floor(col(seconds)), F.lit(0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h "))).otherwise(""), F.when((m > 0) | (h > 0), F.concat(m.cast("string"), F.lit("m "))).otherwise(""), (s % 60).cast("string"), F.lit("s"))


def task_duration(status: Column | str, started: Column | str, completed: Column | str) -> Column:
    """The time that an ended task took, N/A if it isn't known; null for others."""
    known = col(started).isNotNull() & col(completed).isNotNull()
    seconds = F.unix_timestamp(col(completed).cast("timestamp")) - F.unix_timestamp(col(started).cast("timestamp"))
    return F.when(col(status).isin("running", "pending"), F.lit(None).cast("string")).when(known, duration(seconds)).otherwise("N/A")


def task_name(name: Column | str) -> Column:
    c = col(name)
    return F.coalesce(lookup(c, S.TASK_NAMES), F.when(F.startswith(c, F.lit("Ingest Branch: ")), F.concat(F.lit("Ingesting Branch: "), F.substring(c, 16, 1 << 30))), c)


def two_places(x: Column) -> Column:
    """Two decimal places, ties to even as in Python."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


def rounded(x: Column | str, places: int) -> Column:
    """x, a double, to some places as SQL does it: scaled, to the nearest whole number (halves away from zero), and back.

    Spark's own round goes by the shortest decimal: 0.071875 is 0.07188 there, and 0.07187 here since it scales to 7187.499999999999.
    """
    scaled = col(x) * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**places).otherwise(col(x))


def percent(x: Column | str) -> Column:
    return F.concat(two_places(col(x) * 100), F.lit("%"))


def file_name_safe(name: Column | str) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(col(name), r'[<>:"/\\|?*]', ""), r"\s+", " ")), 1, 100)


def is_playlist(url: Column | str) -> Column:
    return F.contains(col(url), F.lit("playlist")) | F.contains(col(url), F.lit("list="))


def minutes_seconds(seconds: Column | str) -> Column:
    s = F.floor(col(seconds)).cast("long")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60))


def is_spoken(line: Column | str) -> Column:
    """Whether a transcript's line is kept: not blank, no bracket at its begin or end."""
    t = F.btrim(col(line), F.lit(" \t\n\r\f\x0b"))
    return (t != "") & ~F.startswith(t, F.lit("[")) & ~F.endswith(t, F.lit("]"))


def font_family(font: Column | str) -> Column:
    c = F.element_at(F.split(col(font), r"\+"), -1)
    low = F.lower(c)
    out = F.when(col(font).isNull() | (col(font) == ""), "Arial, sans-serif")
    for key, family in S.FONTS:
        out = out.when(F.contains(low, F.lit(key.lower())), family)
    quoted = F.concat(F.lit("'"), c, F.lit("'"))
    return out.when(F.contains(low, F.lit("serif")), F.concat(quoted, F.lit(", serif"))).when(F.contains(low, F.lit("mono")), F.concat(quoted, F.lit(", monospace"))).otherwise(F.concat(quoted, F.lit(", sans-serif")))


def font_weight(flags: Column | str) -> Column:
    return F.when(col(flags).bitwiseAND(16) != 0, "bold").otherwise("normal")


def font_style(flags: Column | str) -> Column:
    return F.when(col(flags).bitwiseAND(64) != 0, "italic").otherwise("normal")


def color_code(color: Column | str) -> Column:
    return F.when(col(color) > 0, F.concat(F.lit("#"), F.lower(F.lpad(F.hex(col(color)), 6, "0")))).otherwise("#000000")


# --- vectors --------------------------------------------------------------------------------------


def without_nan(vector: Column | str) -> Column:
    return F.transform(col(vector), lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(x).cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column | str) -> Column:
    """A vector of length 1 in the same direction, as doubles; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal_vector(values: Sequence[float]) -> Column:
    if any(math.isnan(v) for v in values):
        raise ValueError("the query vector holds NaN")
    return F.array(*[F.lit(float(v)) for v in values])
