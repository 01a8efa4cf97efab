"""Line cleaning, paragraphs, aliases, scalars."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from broadsheet.functions import matching, textclean
from broadsheet.functions import scalars as P

CASES = {
    "문의 a.b@c.co.kr": [], "홍길동 기자": [], "입력 2026-01-02 03:04:05": [], "---": [], "한국일보 홍길동 기자 | 은행이 밝혔다.": ["은행이 밝혔다."], "[가나일보=홍길동 기자]은행이 밝혔다.": ["은행이 밝혔다."],
    "이미지 확대보기은행이 밝혔다.": ["은행이 밝혔다."], "주민등록번호를 수집했다.": ["주민등록번호를 수집했다."], "본문이다.\n관련기사\n다른 기사": ["본문이다."], "본문이다.\n- 하나\n- 둘": ["본문이다."], "본문이다.\n- 하나": ["본문이다.", "- 하나"],
    "- 하나\n- 둘\n- 셋": ["- 하나", "- 둘", "- 셋"], "- 하나다.\n- 둘\n- 셋": ["- 하나다."], "　본문이다.\x1c\n \n": ["본문이다."], "": [],
}


def test_clean_lines(spark):
    rows = spark.createDataFrame([*CASES.items(), (None, [])], "text string, want array<string>")
    for r in rows.withColumn("got", textclean.clean_lines(F.col("text"))).collect():
        assert r.got == r.want, r.text


def test_cut_against_a_plain_scan(spark):
    rng, rows = random.Random(5), []
    for _ in range(300):
        lines = [rng.choice(["- a", "– b.", "c", "d.", "e다", "관련기사"]) for _ in range(rng.randrange(0, 7))]
        cut = lines[: lines.index("관련기사")] if "관련기사" in lines else lines
        started = False
        for i, s in enumerate(cut):
            if started and len(cut) - i >= 2 and all(x[0] in "-–—" for x in cut[i:]):
                cut = cut[:i]
                break
            started |= s[-1] in ".다"
        rows.append(("\n".join(lines), cut))
    frame = spark.createDataFrame(rows, "text string, want array<string>")
    assert frame.where(textclean.cut_widgets(textclean.raw_lines(F.col("text"))) != F.col("want")).count() == 0


def test_paragraphs(spark):
    body = "부제, 하나\n문장이다.\n주체, 서술\n◆ 항목\n- 목록, 하나\n끝."
    rows = textclean.classify_paragraphs(spark.createDataFrame([(1, body)], "id long, body string")).orderBy("para_no").collect()
    assert [(r.text, r.is_subtitle) for r in rows] == [("부제, 하나", False), ("문장이다.", False), ("주체, 서술", True), ("항목", True), ("- 목록, 하나", False), ("끝.", False)]


ALIASES = [("storage average fragment", "RAG", False), ("RAG는 좋다", "RAG", True), ("NH농협캐피탈", "농협", True), ("NH농협캐피탈", "NH", True), ("xNH", "NH", False), ("메타데이터", "메타", True), ("x", "", False), ("a c++ b", "C++", True)]


def test_contains_alias_and_matcher_agree(spark):
    for text, alias, want in ALIASES:
        row = spark.createDataFrame([(text,)], "t string").select(matching.contains_alias(F.col("t"), alias).alias("x")).first()
        assert row.x is want, (text, alias)
        assert (matching.AliasMatcher([(7, alias)])(text) == [7]) is want


def test_matcher_against_a_plain_search():
    rng, word = random.Random(1), re.compile(r"[0-9a-z]")
    names = [(i, "".join(rng.choice("ab가") for _ in range(rng.randrange(1, 4)))) for i in range(12)]
    for _ in range(300):
        text = "".join(rng.choice("abc가나 ") for _ in range(rng.randrange(0, 12)))
        want = set()
        for i, n in names:
            for at in range(len(text) - len(n) + 1):
                left = at == 0 or not word.match(n[0]) or not word.match(text[at - 1])
                end = at + len(n)
                if text[at:end] == n and left and (end == len(text) or not word.match(n[-1]) or not word.match(text[end])):
                    want.add(i)
        assert matching.AliasMatcher(names)(text) == sorted(want)


def test_dictionary_in_blocks(spark):
    orgs = spark.createDataFrame([(i, f"name{i}", [f"alias{i}"], i != 3) for i in range(20)], "id long, name string, aliases array<string>, is_active boolean")
    text = spark.createDataFrame([(5, "name1 alias1 alias17, name3 xname5 name50"), (6, None), (7, "")], "news_id long, text string")
    for block in (3, 1000):
        assert sorted((r.news_id, r.entity_id) for r in matching.mentions(text, orgs, block).collect()) == [(5, 1), (5, 17)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(P.strip_html(F.lit(" <b>A</b> &lt;b&gt; &amp; "))) == "A <b> &"
    assert [one(P.pct(F.lit(v), F.lit(8))) for v in (1, 3, 8)] == [12, 38, 100] and one(P.pct(F.lit(1), F.lit(0))) == 0
    assert one(P.display_text(F.lit(""), F.lit("full"))) == "full"
    assert one(P.parse_pub_date(F.lit("never"))) is None
    long, short = F.lit("x" * 200), F.lit("x" * 199)
    assert one(P.coalesce_body(F.lit("o"), F.lit("https://n.news.naver.com/1"), short, long, long)) == "x" * 200
    assert one(P.coalesce_body(F.lit(""), F.lit("l"), long, long, long)) is None
    assert one(matching.token_and_match(F.lit("가 AI 나 은행"), F.lit("은행 ai"))) and not one(matching.token_and_match(F.lit("은행"), F.lit("은행 ai")))


def test_article_text():
    body = "가" * 210
    assert P.article_text(f"<p>x</p><div id='dic_area'>{body}<script>bad()</script><br>끝</div><p>y</p>") == body + "\n끝"
    assert P.article_text("<div id=dic_area>short</div>" + body) is None
    assert P.article_text(f"<nav>menu</nav><article><p>{body}</p></article><footer>foot</footer>") == body
    assert P.article_text(None) is None


def test_planted_lines_meet_every_rule(spark):
    """Each rule takes or trims a planted line, and some lines meet none."""
    from broadsheet.functions import textclean as C
    from broadsheet.sources.adapters import RESIDUE

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(RESIDUE)], "id int, x string")
    got = {RESIDUE[r.id]: r.rule for r in rows.select("id", C.rule_of(F.col("x")).alias("rule")).collect()}
    assert {r for r in got.values() if r} == {name for name, _ in (*C.DROP_RULES, *C.TRIM_RULES)}
    assert all(got[x] is None for x in ("홍길동 기자가 썼다.", "입력 2026-01-02", "----", "advertisements", "자료를 제공했다.", "[기획] 은행의 내일", "copyright 2026", "댓글이 많다.", "▶ 다음 기사", "주민등록번호를 수집했다.", "- 하나"))


def test_keywords_by_one_automaton(spark):
    from broadsheet import schemas as S
    from broadsheet.operators import audit

    rng, parts = random.Random(4), ["ab", "b", "농협", "a", "xy", "A", "  "]
    news = spark.createDataFrame([(i, "".join(rng.choices(parts, k=3)), rng.choice([None, "ab XY", ""])) for i in range(60)] + [(None, "ab", "b")], "id long, title string, body string")
    words = [" ".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(25)] + ["", " "]
    keywords = spark.createDataFrame([(i, w, S.COLLECT, None, True) for i, w in enumerate(words)] + [(99, "off", S.COLLECT, None, False)], "id long, keyword string, keyword_type string, sort string, is_active boolean")
    got = sorted(tuple(r) for r in audit.keyword_matches(news, keywords, block=7).collect())
    text = lambda r: ((r.title or "") + " " + (r.body or "")).lower()
    assert got == sorted((r.id, w) for r in news.collect() if r.id is not None for w in set(words) if all(t in text(r) for t in w.lower().split()))


def test_main_text_of_pages_without_telling_tags():
    """Menus are told by their links; broken and nested markup, references and scripts don't disturb."""
    body = "본문 문장이다. " * 30
    menu = "<div class=m>" + "".join(f"<div><a href=/{i}>메뉴 {i}</a></div>" for i in range(9)) + "</div>"
    page = f"<html><body>{menu}<div id=c><h1><a href=/x>제목이다</a></h1><p>{body}<p>둘째 <a href=/y>링크</a> 문단 &amp; &lt;끝&gt;<div>깊은 <b>글<i>자</b></div><script>var a = '<p>no</p>';</script></div><ul><li><a>더 보기</a><li><a>또 보기</a></ul>"
    assert P.article_text(page) == "\n".join(["제목이다", body.strip(), "둘째", "링크", "문단 & <끝>", "깊은", "글", "자"])
    assert P.article_text(f"<a href=/>{body}</a>") is None and P.article_text(f"<body><div><a>x</a>{body}") == "x\n" + body.strip()


def test_references_cut_before_their_semicolon(spark):
    page = "<p>a &amp; b &ampc &amp</p>&copy; &copy &lt;i&gt; &#38; &#x26; &#38 &ampp; &x; & &&amp;&amp;quot; &é"
    whole = "a & b &ampc &amp© &copy <i> & & &#38 &ampp; &x; & &&&quot; &é"
    got = spark.createDataFrame([(page,), (None,)], "h string").select(P.strip_html(F.col("h"), closed=True), P.strip_html(F.col("h"))).collect()
    assert got[0][0] == whole and got[0][1].startswith("a & b &c &© ©") and got[1][0] == ""
    body = "은행이 밝혔다. " * 30
    one = lambda **kw: spark.createDataFrame([(f"<article><p>{body}</p><p>끝 &amp</p><p>&amp; &lt;</p></article>",), (None,)], "h string").select(P.extract_article_text(F.col("h"), **kw)).collect()
    assert one(closed=True)[0][0].endswith("\n끝 &amp\n& <") and one()[0][0].endswith("\n끝 &\n& <") and one(closed=True)[1][0] is None
