"""Text functions as Columns; they stay inside the JVM. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.config import FOLD_FROM, FOLD_TO, STOP_WORDS

ASCII_PUNCT = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
CJK_PUNCT = "[！？。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～、《》「」『』【】〔〕〖〗“”‘’…—–·・•●○◎◇◆□■△▲▽▼]"


def fold(c: Column) -> Column:
    """Lower case, with the diacritics of Latin letters removed."""
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"[\t\n\x0B\f\r \p{Z}]+", " "))


NOISE = "https?://\\S+|www\\.\\S+|[@#][\\p{L}\\p{N}_]+|" + ASCII_PUNCT + "|" + CJK_PUNCT
WORD = "[一-鿿]|[\\p{L}\\p{N}]+"


def clean_text(c: Column) -> Column:
    """Drops links, mentions, tags and punctuation (not replaced by blanks), collapses blanks."""
    return collapse(F.regexp_replace(c, NOISE, ""))


def segment(c: Column) -> Column:
    """Words of a cleaned text: each ideograph, and each run of other letters and digits."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def keep_tokens(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Without single ASCII characters and stop words (as written)."""
    return F.filter(words, lambda w: ~(w.rlike("^[ -~]$") | w.isin(stop)))


def tokens(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Index tokens of a text, folded; two passes over the text, then one over its words."""
    kept = F.array_join(keep_tokens(segment(F.regexp_replace(c, NOISE, "")), stop), " ")
    return F.filter(F.split(fold(kept), " "), lambda w: w != "")


def canonical_entity(c: Column) -> Column:
    """Edge punctuation and spare blanks go; lower case only where all is ASCII."""
    edge = r"^[\s\p{P}]+|[\s\p{P}]+$"
    v = collapse(F.regexp_replace(c, edge, ""))
    return F.when(v.rlike(r"^[\x00-\x7F]*$"), F.lower(v)).otherwise(v)


def graph_query_tokens(c: Column, most: int = 12) -> Column:
    """Words of two or more characters, the compact string, and its 2- and 3-grams where not ASCII."""
    low = F.lower(collapse(c))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.length(w) >= 2)
    compact = F.regexp_replace(low, r"[^\p{L}\p{N}_]", "")
    n = F.length(compact)
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(compact, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    extra = F.when(compact.rlike(r"[^\x00-\x7F]"), F.concat(F.filter(F.array(compact), lambda w: F.length(w) >= 2), grams(2), grams(3))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(words, extra)), 1, most)


def truncate_around(c: Column, most: int, marker: str = "\n...\n") -> Column:
    """Head and tail around a marker where a text is too long."""
    head = (most - len(marker)) // 2
    tail = most - len(marker) - head
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(head)), F.lit(marker), F.right(c, F.lit(tail)))).otherwise(c)


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(suffix))).otherwise(c)


def history_text(c: Column) -> Column:
    """Collapsed and cut to 64 characters."""
    return truncate(collapse(c), 64)


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; two empty ones have 0."""
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(F.array_union(a, b))
    return F.when(any_ > 0, both / any_).otherwise(F.lit(0.0))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(collapse(c)), " "), lambda w: w != ""))


def bigram_set(c: Column) -> Column:
    """Pairs of neighbours, for short texts and texts without blanks."""
    s = F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", "")
    n = F.length(s)
    return F.array_distinct(F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array(s)))


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard of words, of bigrams where either has fewer than two words."""
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) < 2) | (F.size(y) < 2), jaccard(bigram_set(a), bigram_set(b))).otherwise(jaccard(x, y))


def parse_list(c: Column) -> Column:
    """Parts between commas, semicolons and line ends; ordered and distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,;\n]"), lambda w: F.trim(w)), lambda w: w != ""))


def edit_list(arr: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(arr, lambda w: F.trim(w)), lambda w: w != "")), 1, most)


def csv_guard(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_unguard(c: Column) -> Column:
    return F.when(c.rlike(r"^'[=+\-@\t\r]"), F.substring(c, 2, 1 << 30)).otherwise(c)


def strip_injected(c: Column, head: str, foot: str) -> Column:
    """Removes blocks between a header and a footer; three or more line ends become two."""
    quoted = lambda s: "\\Q" + s + "\\E"
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"(?s){quoted(head)}.*?{quoted(foot)}", ""), r"\n{3,}", "\n\n"))


def content_key(*cols: Column) -> Column:
    """SHA-1 of the parts; a null part counts as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols]))


def content_to_text(c: Column) -> Column:
    """Plain text of a content that may be a JSON list of typed parts; other media leave a mark."""
    parts = F.from_json(c, "array<struct<type:string,text:string>>")
    shown = F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("["), F.coalesce(p["type"], F.lit("media")), F.lit("]"))))
    return F.when(F.trim(c).startswith("[{") & parts.isNotNull(), F.array_join(F.filter(shown, lambda s: s.isNotNull()), " ")).otherwise(c)


def chat_lines(c: Column) -> Column:
    """``[name | HH:MM] text`` lines as structs of speaker, time and text; other lines are left out."""
    pat = r"^\[([^|\]]+) \| ([0-9]{2}:[0-9]{2})\] (.*)$"
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(pat))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pat, 1).alias("speaker"), F.regexp_extract(x, pat, 2).alias("said_at"), F.regexp_extract(x, pat, 3).alias("said")))


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of the settings as a JSON object in a fixed order."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def clamp_k(k: Column, most: int, default: int = 5) -> Column:
    """The number of results asked for, between 1 and ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(k, F.lit(default))))


def patch(old: Column, new: Column) -> Column:
    """A patched value: the new one where it is given."""
    return F.coalesce(new, old)
