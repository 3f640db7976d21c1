"""Column functions over text: style rules, markdown, personal data, splits, tokens, judges.

Patterns carry (?U) where Unicode letters count as word characters and (?d) where only a
line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, patterns and tokens that decide results.
MAX_SPOKEN_WORDS = 60
MAX_SPOKEN_SENTENCES = 4
STYLE_MARKDOWN = r"(?md)(\*\*|__|`|^#{1,6}\s|\[[^\]]+\]\([^)]+\))"
STYLE_BULLET = r"(?md)^\s*([-*+•]|\d+[.)])\s+"
STYLE_URL = r"https?://\S+"
SENTENCE_END = r"(?d)[.!?]+(\s|$)"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
PHONE = r"(?U)(?<![\w])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}\b"
PII = (("email", EMAIL, "[EMAIL]"), ("card", CARD, "[CARD]"), ("phone", PHONE, "[PHONE]"))
SPLITS = ("train", "val", "test")
RATIOS = (0.8, 0.1, 0.1)
STOPWORDS = (
    "a an and are as at be by for from has have how in is it its of on or that the this to was were what when where which "
    "who why will with you your do does did can could should would i we they he she them their our not no yes if then than "
    "so into over under about after before also may might must"
).split()
JUDGE_MARKDOWN = r"(?d)(^|\n)\s*(#{1,6}\s|[-*+]\s|\d+\.\s|>\s|```)|\*\*|__|`"
JUDGE_URL = r"(?i)https?://\S+|www\.\S+"
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def strip(text: Column) -> Column:
    """Without white space at either end (trim only knows the space)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def n_sentences(text: Column) -> Column:
    """Sentence ends, as the style rules count them."""
    return F.regexp_count(strip(text), F.lit(SENTENCE_END))


def count_sentences(text: Column) -> Column:
    """Sentences as the rubric counts them: at least one in a text that isn't blank."""
    return F.when(strip(text) == "", F.lit(0)).otherwise(F.greatest(n_sentences(text), F.lit(1)))


def spoken_style_violations(text: Column) -> Column:
    """Names of the broken rules, in rule order."""
    rules = (
        ("markdown", text.rlike(STYLE_MARKDOWN)),
        ("bullets", text.rlike(STYLE_BULLET)),
        ("url", text.rlike(STYLE_URL)),
        ("too_long", n_words(text) > MAX_SPOKEN_WORDS),
        ("too_many_sentences", n_sentences(text) > MAX_SPOKEN_SENTENCES),
        ("paragraphs", F.contains(strip(text), F.lit("\n\n"))),
    )
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda r: r.isNotNull())


def is_spoken_style(text: Column) -> Column:
    return F.size(spoken_style_violations(text)) == 0


def lines(text: Column) -> Column:
    """Lines by any line break; a break at the end leaves an empty last one.

    A pattern is tried at every character, so a text without the breaks beside the line feed is split by that alone.
    """
    rare = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"])
    return once(lambda t: F.when(rare(t), F.split(t, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).otherwise(F.split(t, "\n")), text)


def strip_markdown_retrieval(text: Column) -> Column:
    """Plain text for an answer: no headings, link targets, emphasis or bullets; trimmed lines, blank ones dropped."""
    for pattern, by in ((r"(?md)^\s{0,3}#{1,6}\s*", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(\*{1,3}|`{1,3})", ""), (r"(?md)^\s*[-*+]\s+", ""), (r"[ \t]+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.array_join(F.filter(F.transform(lines(text), strip), lambda x: x != ""), "\n")


def strip_markdown_training(text: Column) -> Column:
    """Plain text for training: also fences, inline code and paired emphasis; one line."""
    steps = (
        (r"(?s)```.*?```", " "),
        (r"`([^`]*)`", "$1"),
        (r"(?md)^\s{0,3}#{1,6}\s*", ""),
        (r"(?md)^\s*(?:[-*+]|\d+[.)])\s+", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?d)(\*\*|__|\*|_)(?=\S)(.+?)(?<=\S)\1", "$2"),
    )
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.array_join(F.filter(F.transform(lines(text), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), " ")


def is_spoken_training(text: Column, max_words: int = MAX_SPOKEN_WORDS) -> Column:
    """Few words, and nothing that the training clean-up would change but white space."""
    flat = strip(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), r"[ \t]+", " "))
    return (n_words(text) <= max_words) & (strip_markdown_training(text) == flat)


def scrub(text: Column, kinds: tuple = PII) -> tuple[Column, dict[str, Column]]:
    """(text with placeholders, number of replacements of each kind); kinds apply in order, each to what the last left."""
    counts = {}
    for name, pattern, token in kinds:
        counts[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, token)
    return text, counts


def pii_map(counts: dict[str, Column]) -> Column:
    """Only the kinds that occur."""
    pairs = [x for name, n in counts.items() for x in (F.lit(name), n)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v > 0)


def split_fraction(key: Column, salt: str = "") -> Column:
    """Stable number in [0, 1]: the first 64 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def assign_split(key: Column, ratios: tuple[float, float, float] = RATIOS, salt: str = "") -> Column:
    if abs(sum(ratios) - 1.0) > 1e-6 or any(r < 0 for r in ratios):
        raise ValueError(f"ratios must be non-negative and sum to 1: {ratios}")
    x, edge, out = split_fraction(key, salt), 0.0, None
    for name, r in zip(SPLITS, ratios, strict=True):
        edge += r
        out = F.when(x < edge, name) if out is None else out.when(x < edge, name)
    return out.otherwise(SPLITS[-1])


def utterance_group_key(meta: Column, speaker: Column, id_: Column) -> Column:
    """Session, then speaker, then the utterance itself; empty values are skipped."""
    return F.coalesce(F.nullif(meta["session"], F.lit("")), F.nullif(meta["session_id"], F.lit("")), F.nullif(speaker, F.lit("")), id_)


def tokens(text: Column, drop_stopwords: bool = False) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    if drop_stopwords:
        stop = F.array(*[F.lit(w) for w in STOPWORDS])
        found = F.filter(found, lambda t: ~F.array_contains(stop, t))
    return found


def bigrams(found: Column) -> Column:
    return F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def once(f: Callable[[Column], Column], value: Column) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def grams(text: Column) -> Column:
    """Tokens and pairs of neighbours, stopwords included; repeats stay."""
    return once(lambda found: F.concat(found, bigrams(found)), tokens(text))


def informative(gram: Column) -> Column:
    """Not made of stopwords alone."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.exists(F.split(gram, " "), lambda t: ~F.array_contains(stop, t))


def normalise(text: Column) -> Column:
    """Lower-case words for error rates: hyphens separate, other ASCII punctuation goes."""
    return words(F.regexp_replace(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), PUNCTUATION, ""))


def normalise_training(text: Column) -> Column:
    """Lower-case text without ASCII punctuation (hyphens join words), white space collapsed."""
    return F.array_join(words(F.regexp_replace(F.lower(text), PUNCTUATION, "")), " ")


def exact_match(reference: Column, hypothesis: Column) -> Column:
    return normalise(reference) == normalise(hypothesis)


def cer_parts(reference: Column, hypothesis: Column) -> tuple[Column, Column, Column]:
    """(errors, reference characters, hypothesis characters) on normalised text without spaces."""
    r, h = F.array_join(normalise(reference), ""), F.array_join(normalise(hypothesis), "")
    return F.levenshtein(r, h), F.length(r), F.length(h)


def error_rate(errors: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Errors over reference length; an empty reference gives the hypothesis length."""
    return F.when(n_ref == 0, n_hyp.cast("double")).otherwise(errors / n_ref)


def rubric(
    text: Column, max_sentences: int = 3, max_words: int | None = None, phrases: tuple[str, ...] = (), *, require_nonempty: bool = True, forbid_markdown: bool = True, forbid_urls: bool = True
) -> dict[str, Column]:
    """The enabled checks of a spoken answer, in order; each forbidden phrase is a check of its own."""
    every = (
        (require_nonempty, "nonempty", strip(text) != ""),
        (True, "max_sentences", count_sentences(text) <= max_sentences),
        (max_words is not None, "max_words", n_words(text) <= F.lit(max_words)),
        (forbid_markdown, "no_markdown", ~text.rlike(JUDGE_MARKDOWN)),
        (forbid_urls, "no_urls", ~text.rlike(JUDGE_URL)),
    )
    checks = {name: check for on, name, check in every if on}
    lower = F.lower(text)
    return checks | {f"without {p}": ~F.contains(lower, F.lit(p.lower())) for p in phrases}


def rubric_score(text: Column, **options: object) -> Column:
    checks = rubric(text, **options)
    return reduce(lambda a, b: a + b, [c.cast("int") for c in checks.values()]) / F.lit(len(checks))


def parse_score(reply: Column) -> Column:
    """The first number of a judge's reply, brought to 0..1: over 1 is out of 10, over 10 out of 100."""
    v = F.nullif(F.regexp_extract(reply, r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")
    scaled = F.when((v > 1) & (v <= 10), v / 10).when(v > 10, v / 100).otherwise(v)
    return F.coalesce(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def contains_words(haystack: Column, needle: Column) -> Column:
    """Whether the needle's normalised words stand in a row in the haystack."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(normalise(t), " "), F.lit(" "))
    return F.contains(pad(haystack), pad(needle))


def edge_segments(text: Column) -> Column:
    """Sentences by punctuation alone: the fallback of small devices."""
    return F.regexp_extract_all(text, F.lit(r"(?d)(.+?[.!?]+)(?:\s+|$)"), F.lit(1))


def host_allowed(host: Column, patterns: Column) -> Column:
    """Patterns: ``*``, a host, or ``*.suffix``."""
    return F.exists(patterns, lambda p: (p == "*") | (p == host) | (p.startswith("*.") & F.endswith(host, F.substring(p, F.lit(2), F.length(p)))))


def version_tuple(version: Column) -> Column:
    """Numeric parts of a dotted version; arrays compare part by part."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "[^0-9]", ""), F.lit("")).cast("int"), F.lit(0)))


def noisy(text: Column, seed: int = 0, drop: float = 0.1, swap: float = 0.0) -> Column:
    """A transcript with errors: each word has a draw of its own, from the seed, the text and its place, that drops it, reverses it or leaves it."""
    share = float(1 << 30)
    drawn = F.transform(words(text), lambda w, i: F.struct(w.alias("w"), (F.pmod(F.xxhash64(F.lit(seed), text, i), F.lit(1 << 30)) / F.lit(share)).alias("u")))
    kept = F.filter(drawn, lambda x: x["u"] >= F.lit(drop))
    return F.array_join(F.transform(kept, lambda x: F.when(x["u"] < F.lit(drop + swap), F.reverse(x["w"])).otherwise(x["w"])), " ")


def template(pattern: str, **fields: Column) -> Column:
    """A text with {name} replaced by the row's fields, null as nothing; what stands in for a language model in tests."""
    out = F.lit(pattern)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
