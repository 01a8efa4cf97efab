"""Line cleaning of article bodies: one program, used by tagging, display and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import SPACE, let, strip

# The residue rules of the news outlets, in their order. Lines that match go.
DROP_RULES = (
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("byline", r"^(?:\S{1,15}\s+)?[가-힣]{2,4}\s*기자$"),
    ("timestamp", r"^(입력|수정)\s*[:：]?\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}(:\d{2})?$"),
    ("ad", r"^(?i:advertisement)$"),
    ("dash", r"^[-–—]{1,3}$"),
    ("photo_credit", r"^[가-힣A-Za-z0-9]{1,10}\s*제공$"),
    ("series", r"^\[[^\[\]]*[①②③④⑤⑥⑦⑧⑨⑩][^\[\]]*\]"),
    ("copyright", r"무단\s*전재|재배포|재판매|(?i:copyright.*reserved)"),
    ("caption", r"사진\s*제공\s*=|사진\s*=|그래픽\s*=|\[[^\[\]]{0,30}제공\]\s*$|ⓒ\s*\S+\s+[가-힣]{2,4}\s*(기자|디자이너)\s*$"),
    ("comment_ui", r"^댓글\s*\(\d+\)$|자\s*이내로\s*써주세요|댓글은\s*표시가\s*제한"),
    ("promo", r"^\[제보\]|^\[구독\]|구독해주세요|제보를\s*기다립니다|^▶(카카오톡|뉴스\s*홈페이지|이메일)\s*[:：]"),
    ("masthead", r"(인터넷신문|사업자|신문사업)\s*등록번호|청소년\s*보호\s*책임자|(?i:Tel\s*[:：].*Fax\s*[:：])|읽는\s*\[[^\[\]]{1,20}\]\s*$"),
)
# What is cut off the front of a line, in their order.
TRIM_RULES = (
    ("byline_prefix", r"^(?:\S{1,15}\s+)?[가-힣]{2,4}\s*기자\s*[|·]\s*"),
    ("outlet_prefix", r"^\[[^\[\]]{1,20}=[^\[\]]{1,20}(기자|특파원)\]\s*"),
    ("image_button", r"^이미지\s*확대보기"),
)
WIDGET_MARKERS = ("관련기사", "추천 뉴스")
BULLETS = ("-", "–", "—")
SUBTITLE_MARKER = r"^[◆◇■◼□]\x{FE0E}?\s*"
SUBTITLE_LENGTH = 45

_U = "(?Ud)"  # Unicode classes, and \n as the only line end, as in the rules' first engine


def ends_with_terminal(c: Column) -> Column:
    """Ends like a sentence, closing quotes and brackets, and white space before them, aside."""
    return c.rlike(rf"""(?Us)[.!?다요]{SPACE}*[\"'“”‘’()\[\]『』「」《》]*\z""")


def is_bullet(c: Column) -> Column:
    return c.rlike("^[" + "".join(BULLETS) + "]")


def rule_of(line: Column) -> Column:
    """The first rule that drops a line, else the first that trims it, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed((*DROP_RULES, *TRIM_RULES)):
        out = F.when(line.rlike(_U + pattern), name).otherwise(out)
    return out


# An address has its @, and one character on each side finds it; a line that any other rule drops holds
# one of these hints, which are far cheaper to look for than the rules.
_EMAIL = _U + r"[\w.+-]@[\w-]+\.[\w.-]"
_HINTS = _U + r"^\[|^[-–—]|기자|디자이너|입력|수정|제공|전재|재배포|재판매|사진|그래픽|댓글|써주세요|제보|구독|^▶|등록번호|보호|읽는|(?i:advertisement|copyright|tel)"
_DROP = _U + "|".join(f"(?:{p})" for name, p in DROP_RULES if name != "email")
_TRIM_HINTS = _U + "기자|특파원|^이미지"


def is_residue(line: Column) -> Column:
    """Whether any rule drops the line."""
    return (line.contains("@") & line.rlike(_EMAIL)) | (line.rlike(_HINTS) & line.rlike(_DROP))


def trim_line(line: Column) -> Column:
    """A stripped line without what the rules cut off its front."""
    trimmed = line
    for _, pattern in TRIM_RULES:
        trimmed = F.regexp_replace(trimmed, _U + pattern, "")
    return F.when(line.rlike(_TRIM_HINTS), strip(trimmed)).otherwise(line)


def raw_lines(text: Column) -> Column:
    """The stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), strip), lambda x: x != "")


def _places(lines: Column, test) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _before_marker(lines: Column) -> Column:
    first = F.array_min(_places(lines, lambda x: x.isin(*WIDGET_MARKERS)))
    return let(first, lambda at: F.when(at.isNull(), lines).otherwise(F.slice(lines, 1, F.coalesce(at, F.lit(0)))))


def _before_bullets(lines: Column) -> Column:
    sentence = F.array_min(_places(lines, ends_with_terminal))
    prose = F.coalesce(F.array_max(_places(lines, lambda x: ~is_bullet(x))), F.lit(-1))
    at = let(sentence, lambda s: F.when(s.isNotNull(), F.greatest(prose, s) + 1))
    return let(at, lambda a: F.when(F.size(lines) - a >= 2, F.slice(lines, 1, F.coalesce(a, F.lit(0)))).otherwise(lines))


def cut_widgets(lines: Column) -> Column:
    """Cuts from the first widget header, then a trailing block of two or more bullet lines that follows
    a sentence."""
    return let(lines, lambda whole: let(_before_marker(whole), _before_bullets))


def clean_lines(text: Column) -> Column:
    """array<string>: the body's lines without scrape residue. Null and empty give no lines."""
    kept = F.filter(cut_widgets(raw_lines(text)), lambda x: ~is_residue(x))
    return F.filter(F.transform(kept, trim_line), lambda x: x != "")


def clean_text(text: Column) -> Column:
    """The cleaned lines as one text, for alias matching."""
    return F.array_join(clean_lines(text), "\n")


def classify_paragraphs(news: DataFrame, body: str = "body") -> DataFrame:
    """(news_id, para_no, text, is_subtitle). Marked lines are subtitles anywhere; others only after a
    sentence, if they are short, no sentence and hold a comma or an ellipsis."""
    lines = news.select(F.col("id").alias("news_id"), clean_lines(F.col(body)).alias("lines"))
    marked = lambda x: x.rlike(_U + SUBTITLE_MARKER)
    started = F.array_min(F.filter(F.transform("lines", lambda x, i: F.when(~marked(x) & ends_with_terminal(x), i)), lambda i: i.isNotNull()))
    rows = lines.select("news_id", started.alias("started"), F.posexplode("lines").alias("para_no", "p"))
    p = F.col("p")
    shape = ~is_bullet(p) & (F.char_length(p) <= SUBTITLE_LENGTH) & ~ends_with_terminal(p) & (p.contains("…") | p.contains("..") | p.contains(","))
    generic = F.coalesce(F.col("para_no") > F.col("started"), F.lit(False)) & shape
    text = F.when(marked(p), strip(F.regexp_replace(p, _U + SUBTITLE_MARKER, ""))).otherwise(p)
    return rows.select("news_id", "para_no", text.alias("text"), (marked(p) | generic).alias("is_subtitle"))


def residue_stats(news: DataFrame, body: str = "body") -> DataFrame:
    """(source_type, rule, lines): how many lines each rule takes or trims for each source."""
    lines = news.select("source_type", F.explode(cut_widgets(raw_lines(F.col(body)))).alias("line"))
    return lines.withColumn("rule", rule_of(F.col("line"))).where("rule is not null").groupBy("source_type", "rule").agg(F.count(F.lit(1)).alias("lines"))
