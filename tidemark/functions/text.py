"""Text functions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens are runs of ASCII word characters and hyphens, or one CJK character (RUNS: a run of them).
TOKEN = r"[A-Za-z0-9_\-]+|[一-鿿]"
TOKEN_RUNS = r"[A-Za-z0-9_\-]+|[一-鿿]+"
#: Words that are no keywords.
STOPWORDS = ["怎么", "如何", "请问", "一下", "这个", "那个", "什么", "是否", "可以", "需要", "怎么做", "处理", "问题", "告警", "故障", "机器", "设备", "agent"]
#: Words left out of fingerprints.
FINGERPRINT_STOPWORDS = ["请问", "一下", "这个", "那个", "问题", "可以", "需要", "是否", "怎么", "如何", "一下子", "我想", "帮忙", "请", "下"]
#: Phrases rewritten, in this order, before fingerprinting.
PHRASES = [
    ("怎么办", " handle "),
    ("怎么处理", " handle "),
    ("如何处理", " handle "),
    ("咋处理", " handle "),
    ("报码", " alarm "),
    ("报错", " alarm "),
    ("告警", " alarm "),
    ("排查", " troubleshoot "),
    ("诊断", " troubleshoot "),
]
#: Tokens with a canonical form.
CANONICAL = {
    "怎么办": "handle",
    "怎么处理": "handle",
    "如何处理": "handle",
    "报码": "alarm",
    "报错": "alarm",
    "告警": "alarm",
    "排查": "troubleshoot",
    "诊断": "troubleshoot",
}
#: Line ends as text is split into lines, and white space that Unicode's class leaves out (a class body).
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACE = r"\s\x1c-\x1f"
#: What stands for a missing file name, and the words of references and answers.
UNKNOWN_FILE = "未知来源"
#: Title lines of page sections and their kinds.
SECTION_KINDS = [("故障现象|现象描述", "fault_symptom"), ("故障原因|原因分析", "root_cause"), ("处理步骤|维修步骤|操作步骤", "repair_steps"), ("注意事项|风险提示", "attention")]
TITLE_CHARACTERS = r"^[一二三四五六七八九十0-9.\-、（）()\sA-Za-z一-鿿]+$"
TITLE_ENDINGS = "步骤|说明|流程|处理|分析"
BODY_TITLE = "正文"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RUNS), F.lit(0))


def squash(text: Column) -> Column:
    """White space, Unicode's included, collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, f"(?U)[{SPACE}]+", " "))


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def some(text: Column) -> Column:
    """Null for empty strings, so that concat_ws leaves them out."""
    return F.when(text != "", text)


def keywords(text: Column, most: int = 12) -> Column:
    """Distinct tokens in order of appearance, longer than one character, no stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))), 1, most)


def overlap(words: Column, text: Column) -> Column:
    """Share of the words that are tokens of the text; 0 without words."""
    own = F.filter(words, lambda w: w != "")
    found = tokens(F.coalesce(text, F.lit("")))
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: F.array_contains(found, w))) / F.size(own)).otherwise(0.0)


def normalize_query(text: Column) -> Column:
    out = F.trim(F.lower(text))
    for phrase, word in PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(word))
    return squash(F.regexp_replace(out, r"(?U)[^\w一-鿿]+", " "))


def canonical(token: Column) -> Column:
    clean = F.lower(F.trim(token))
    table = F.create_map(*(F.lit(x) for pair in CANONICAL.items() for x in pair))
    return F.coalesce(F.try_element_at(table, clean), clean)


def fingerprint(normalized: Column, keyword_query: Column, words: Column) -> Column:
    """Sorted distinct canonical tokens joined by |; without any, the query with underscores."""
    stop = F.array(*map(F.lit, FINGERPRINT_STOPWORDS))
    all_tokens = F.concat(token_runs(normalized), token_runs(F.coalesce(keyword_query, F.lit(""))), F.coalesce(words, F.array().cast("array<string>")))
    kept = F.filter(F.transform(all_tokens, canonical), lambda t: (t != "") & ~F.array_contains(stop, t))
    joined = F.array_join(F.array_sort(F.array_distinct(kept)), "|")
    return F.when(F.size(kept) > 0, joined).otherwise(F.replace(normalized, F.lit(" "), F.lit("_")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[ \\/:*?"<>|]', "_")


def mask_secret(secret: Column) -> Column:
    """First eight and last four characters; secrets of eight or fewer are masked whole."""
    return F.when(F.length(secret) > 8, F.concat(F.left(secret, F.lit(8)), F.lit("..."), F.right(secret, F.lit(4)))).otherwise("***")


def section_path(*headers: Column) -> Column:
    return F.concat_ws(" > ", *(some(h) for h in headers))


def reference_line(file_name: Column, page: Column, section: Column) -> Column:
    return F.concat_ws(" / ", some(file_name), page.cast("string"), some(section))


def page_reference(file_name: Column, page: Column, section: Column) -> Column:
    """A reference with its page as readers see it; page 0 counts as none."""
    return F.concat_ws(" / ", F.coalesce(file_name, F.lit(UNKNOWN_FILE)), F.when(page != 0, F.concat(F.lit("第"), page.cast("string"), F.lit("页"))), some(strip(section)))


def is_title(line: Column) -> Column:
    """The kind of section a title line opens; null for other lines."""
    plain = (F.length(line) <= 32) & line.rlike(f"(?U){TITLE_CHARACTERS}")
    kind = F.when(line.rlike(f"({TITLE_ENDINGS})$"), "pdf_section")
    for names, label in reversed(SECTION_KINDS):
        kind = F.when(line.rlike(f"(?U)^({names})[:：]?\\s*$"), label).otherwise(kind)
    return F.when(plain, kind)


def optional_text(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def optional_int(value: Column) -> Column:
    return value.try_cast("int")


def optional_double(value: Column) -> Column:
    return value.try_cast("double")
