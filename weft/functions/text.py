"""Text functions as column expressions: keys, questions, synonyms, verdicts, redaction, display forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a symbol in an identifier, in the order of replacement.
URI_REPLACEMENTS = (
    ("->", "_to_"), ("<-", "_from_"), (">=", "_gte_"), ("<=", "_lte_"), ("!=", "_ne_"), ("=", "_eq_"), ("<", "_lt_"), (">", "_gt_"),
    ("%", "_pct"), ("&", "_and"), ("+", "_plus"), ("@", "_at"), ("/", "_"), ("\\", "_"), (" ", "_"),
)
# Words that frame a question, and words that a signature leaves out.
FRAME = ("a", "an", "are", "did", "do", "does", "for", "give", "in", "is", "list", "lists", "me", "of", "please", "show", "tell", "the", "there", "what", "which")
STOP = ("what", "is", "a", "the", "of", "that", "and")
# Keys whose values are secrets.
SECRET_KEYS = ("api_key", "apikey", "api-key", "authorization", "auth", "token", "password", "passwd", "pwd", "secret", "client_secret", "access_token", "private_key", "key")
# Phrases before other names.
ALSO = (r"also known as ([^.;\n]+)", r"\baka\b ([^.;\n]+)", r"other names? include ([^.;\n]+)", r"alternatively called ([^.;\n]+)", r"sometimes called ([^.;\n]+)")
WORD = "[a-z0-9]+(?:-[a-z0-9]+)*"
OVERLAP, MARGIN, SHINGLES = 0.75, 0.15, 4


def uri_component(value: Column) -> Column:
    for old, new in URI_REPLACEMENTS:
        value = F.replace(value, F.lit(old), F.lit(new))
    value = F.regexp_replace(value, r"""[()\[\]{}?# !$,;:'".]""", "")
    value = F.trim(F.regexp_replace(value, "_+", "_"), F.lit("_"))
    return F.when(value == "", "unknown_type").otherwise(value)


def question_key(text: Column) -> Column:
    """Lower case, single blanks, without ' ?.!' at the ends."""
    return F.trim(F.regexp_replace(F.trim(F.lower(text), F.lit(" \t\n\r\f\x0b")), r"\s+", " "), F.lit(" ?.!"))


def stem(word: Column) -> Column:
    ies = (F.length(word) > 5) & F.endswith(word, F.lit("ies"))
    plural = (F.length(word) > 4) & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss"))
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return F.when(ies, F.concat(cut(3), F.lit("y"))).when(plural, cut(1)).otherwise(word)


def content_key(text: Column) -> Column:
    """Sorted distinct stems of the words that do not frame the question."""
    words = F.filter(F.regexp_extract_all(question_key(text), F.lit(WORD), 0), lambda w: ~w.isin(*FRAME))
    return F.array_sort(F.array_distinct(F.transform(words, stem)))


def signature_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), lambda w: ~w.isin(*STOP))


def shingles(words: Column, n: int = 3) -> Column:
    """Distinct runs of n words."""
    tail = lambda k: F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    joined = tail(0)
    for k in range(1, n):
        joined = F.zip_with(joined, tail(k), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(joined)


def overlap(query: Column, answer: Column) -> Column:
    """Share of the query's shingles that the answer has."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, answer)), F.size(query)), F.lit(0.0))


def bounded_distance(a: Column, b: Column) -> Column:
    """Edit distance up to 1; 2 stands for more."""
    d = F.levenshtein(a, b, 1)
    return F.when(d < 0, 2).otherwise(d)


def first_sentence(text: Column, limit: int) -> Column:
    return F.substring(F.get(F.split(F.trim(text), r"(?<=[.!?])\s+", 2), F.lit(0)), 1, limit)


def synonyms(text: Column, term: Column) -> Column:
    """Names that prose gives beside a term: after 'also known as' and the like, and in parentheses after the term."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?i)" + p), 1) for p in ALSO)))
    aside = F.regexp_extract_all(text, F.concat(F.lit(r"(?i)\b\Q"), term, F.lit(r"\E\b\s*\(([^)]+)\)")), 1)
    parts = F.flatten(F.transform(F.concat(found, aside), lambda c: F.split(c, r",|;|\bor\b|/|\\")))
    tidy = F.transform(parts, lambda c: F.lower(F.trim(c, F.lit(" ()[]{}\"'"))))
    return F.array_distinct(F.filter(tidy, lambda c: (c != "") & (c != F.lower(term))))


def terms(value: Column) -> Column:
    """A JSON list of strings, or text delimited by | , ; or newlines, as an array of trimmed terms."""
    listed = F.from_json(F.when(F.trim(value).startswith("["), value), "array<string>")
    split = F.split(value, r"[|,;\n]")
    return F.filter(F.transform(F.coalesce(listed, split), lambda c: F.trim(c)), lambda c: c != "")


def first_given(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def yes_no(text: Column) -> Column:
    """True or false for an unambiguous YES or NO (tagged, in JSON, or the only such word); else null."""
    tagged = F.regexp_extract(text, r"(?i)<Answer>\s*(YES|NO)\s*</Answer>", 1)
    given = F.regexp_extract(text, r"""(?i)["']answer["']\s*:\s*["'](yes|no)["']""", 1)
    said = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(YES|NO)\b"), 1), F.upper))
    word = F.when(tagged != "", F.upper(tagged)).when(given != "", F.upper(given)).when(F.size(said) == 1, F.get(said, F.lit(0)))
    return word == "YES"


def stated_confidence(text: Column) -> Column:
    """The number in <Confidence>, or -1."""
    found = F.regexp_extract(text, r"(?i)<Confidence>\s*([0-9]+(?:\.[0-9]+)?)\s*</Confidence>", 1)
    return F.when(found != "", found.cast("double")).otherwise(-1.0)


def clamp(score: Column) -> Column:
    """In [0, 1]; NaN is no score."""
    return F.when(F.isnan(score), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def redacted(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?i)\bBearer\s+\S+", "Bearer ******")
    text = F.regexp_replace(text, r"(?i)\bsk-[A-Za-z0-9]{16,}\b", "sk-******")
    return F.regexp_replace(text, r"(?i)\bghp_[A-Za-z0-9]{20,}\b", "ghp_******")


def redacted_map(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), "******").otherwise(redacted(v)))


def preview(text: Column, limit: int = 240) -> Column:
    """On one line, cut after limit characters."""
    one = F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), r"^\s+|\s+$", "")
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("…"))).otherwise(one)


def variables(template: str) -> list[str]:
    """Names in single or double braces."""
    return sorted(set(re.findall(r"\{\s*([A-Za-z_]\w*)\s*\}", template)))


def rendered(template: str, values: Mapping[str, Column]) -> Column:
    """{name} filled in; names without a value stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def term_iri(value: Column, base: str) -> Column:
    """An IRI in angle brackets, or a minted one."""
    iri = F.concat(F.lit("<"), F.replace(value, F.lit(">"), F.lit("%3E")), F.lit(">"))
    safe = F.replace(F.url_encode(F.replace(value, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    return F.when(value.rlike("^https?://"), iri).otherwise(F.concat(F.lit(f"<{base}"), safe, F.lit(">")))


def human_join(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def match_score(name: Column, term: Column) -> Column:
    """10 for the name itself, 6 where it begins with the term, 3 where it contains it."""
    n, t = F.lower(name), F.lower(term)
    return F.when(n == t, 10.0).when(F.startswith(n, t), 6.0).when(F.contains(n, t), 3.0).otherwise(0.0)


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition makes of characters, as far as it is ASCII: those that become one character, and several."""
    one, more = {}, {}
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2190), *range(0x2460, 0x24EB), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))):
        form = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        (one if len(form) == 1 else more)[c] = form
    return one, {c: form for c, form in more.items() if form}


_ONE, _MORE = _folds()


def ascii_fold(text: Column) -> Column:
    """Letters without their marks, and other characters as ASCII where they have such a form; the rest goes."""
    text = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    several = F.create_map(*(F.lit(x) for pair in _MORE.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    text = F.when(text.rlike("[^\\x00-\\x7F]"), spelled).otherwise(text)
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "")


def slug(text: Column, limit: int = 50) -> Column:
    """ASCII-only slug of at most limit characters; a text without any ASCII form is underscores."""
    given = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    plain = F.coalesce(F.nullif(ascii_fold(given), F.lit("")), given)
    tidy = F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, limit)
    tidy = F.trim(F.regexp_replace(F.regexp_replace(tidy, "[^a-zA-Z0-9._-]+", "_"), "_+", "_"), F.lit("._"))
    return F.when(tidy == "", "query").otherwise(tidy)


# Headings of a prompt that an answer should not repeat, and signs of a plan to use tools.
ECHOES = ("relevant concept clusters", "key relations", "concept clusters", "from cluster", "(cluster", "most relevant concepts", "relevant concepts")
MONOLOGUE = ("tool_name", "i will use the tools")


def echoes_prompt(sentence: Column) -> Column:
    low = F.lower(sentence)
    known = F.lit(False)
    for heading in ECHOES:
        known = known | F.contains(low, F.lit(heading))
    return known | (F.contains(low, F.lit("cluster")) & low.rlike(r"\d"))


def without_echo(text: Column) -> Column:
    """An answer without the sentences that repeat the prompt's headings or cite a numbered cluster; lines and paragraphs that empty go."""
    sentence = lambda line: F.filter(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"(?<!\d[.!?])(?<=[.!?])\s+"), lambda x: (x != "") & ~echoes_prompt(x))
    line = lambda part: F.filter(F.transform(F.split(part, r"\r\n|\n|\r"), lambda x: F.array_join(sentence(x), " ")), lambda x: x != "")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.array_join(line(p), "\n")), lambda p: p != "")
    return F.regexp_replace(F.array_join(paragraphs, "\n\n"), r"^\s+|\s+$", "")


def presentable(text: Column) -> Column:
    """without_echo(), or nothing where the text is a plan to use tools."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit(MONOLOGUE[0])) | F.contains(low, F.lit(MONOLOGUE[1])), "").otherwise(without_echo(text))


def corrected(query: Column, answer: Column) -> Column:
    """query words (array) with their only word that answer lacks, of five letters and more, replaced by the one answer word at
    edit distance 1; null where that cannot be done.
    """
    missing = F.filter(query, lambda w: ~F.array_contains(answer, w))
    word = F.get(missing, F.lit(0))
    near = F.filter(F.array_distinct(answer), lambda a: bounded_distance(word, a) == 1)
    fits = (F.size(missing) == 1) & (F.length(word) >= 5) & (F.size(near) == 1)
    return F.when(fits, F.transform(query, lambda w: F.when(w == word, F.get(near, F.lit(0))).otherwise(w)))


def rendered_pattern(ids: Column, edges: Column, base: str) -> Column:
    """A graph pattern of the concepts ids (array): ?c0, ?c1 ... and what each is, then the edges (struct src, pred, tgt) between them."""
    at = lambda x: F.concat(F.lit("?c"), F.array_position(ids, x) - 1)
    kinds = F.transform(ids, lambda x, i: F.concat(F.lit("?c"), i, F.lit(" a "), term_iri(x, base), F.lit(" .")))
    known = F.filter(edges, lambda e: F.array_contains(ids, e["src"]) & F.array_contains(ids, e["tgt"]))
    links = F.transform(known, lambda e: F.concat(at(e["src"]), F.lit(" <"), e["pred"], F.lit("> "), at(e["tgt"]), F.lit(" .")))
    return F.array_join(F.concat(kinds, links), "\n")
