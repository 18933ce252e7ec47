"""Web page, URL and attachment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Registry
from parlance import fixtures as fx
from parlance.functions import text, urls
from parlance.operators import web as op

REG = Registry()
QUERIES, ORACLE = REG.queries, REG.oracle


def _plain(col):
    # Browsers also read these names where a cut has taken their semicolon.
    for entity, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        col = f"regexp_replace({col}, '&{entity};?', '{char}', 'g')"
    return col


# Blocks become chr(1), paragraphs chr(2); the strongest mark of a run decides its newlines.
def _visible(col):
    out = f"regexp_replace({col}, '<!--.*?-->|<(?:b|a)(?: [^>]*)?>|</(?:b|a|body|html)>', '', 'gs')"
    out = f"regexp_replace({out}, '<br>', chr(3), 'g')"
    out = f"regexp_replace({out}, '</?p>', chr(2), 'g')"
    out = f"regexp_replace({out}, '</?(?:h1|nav|ul|li|div|article|footer)(?: [^>]*)?>', chr(1), 'g')"
    out = f"regexp_replace({out}, '[ \\n\\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' ?([\\x01\\x02\\x03]) ?', '\\1', 'g')"
    out = f"regexp_replace({out}, '[\\x01\\x02]*\\x02[\\x01\\x02]*', chr(10) || chr(10), 'g')"
    out = f"regexp_replace(replace({out}, chr(3), chr(10)), '\\x01+', chr(10), 'g')"
    return f"trim({_plain(out)}, ' ' || chr(10))"


CONTENT_SQL = f"""shown AS (SELECT page_id, url, html, {_visible("regexp_extract(html, '<article>(.*?)(?:</article>|$)', 1, 's')")} AS art,
    {_visible("regexp_extract(html, '<body>(.*)$', 1, 's')")} AS body FROM pages),
content AS (SELECT page_id, url, html, regexp_replace(CASE WHEN length(art) > 0 AND length(art) >= length(body) * 0.25 THEN art ELSE body END,
    '\\n\\n+', chr(10) || chr(10), 'g') AS text,
    list_transform(regexp_extract_all(html, '<h1>(.*?)</h1>', 1), lambda x: trim({_plain('x')})) AS headings,
    regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1) AS names FROM shown)"""


@REG.add(
    "extract_content",
    f"""WITH {CONTENT_SQL} SELECT page_id, trim({_plain("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title,
      regexp_extract(html, '<html lang="(.*?)"', 1) AS lang, '' AS description,
      CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || chr(10) || '[内容过长，已截断到 2000 字]' ELSE text END AS text,
      array_to_string(headings, '|') AS headings FROM content""",
)
def _content(spark, sf_dir):
    rows = op.extract_content(fx.table(spark, sf_dir, "pages"), max_chars=2000)
    return rows.select(
        "page_id", "title", "lang", "description", "text",
        F.array_join("headings", "|").alias("headings"),
    )


@REG.add(
    "page_links",
    f"""WITH {CONTENT_SQL}, l AS (SELECT page_id, i, names[i] AS name, regexp_extract(url, '^https?://[^/]+', 0) ||
        replace(replace(url_encode(hrefs[i]), '%2F', '/'), '%2C', ',') AS href FROM content, unnest(range(1, least(40, len(hrefs)) + 1)) AS r(i)),
    f AS (SELECT page_id, name, href, min(i) AS i FROM l GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY min(i)) <= 20)
    SELECT page_id, string_agg(name || ' ' || href, '|' ORDER BY i) AS links FROM f GROUP BY 1""",
)
def _links(spark, sf_dir):
    rows = op.extract_content(fx.table(spark, sf_dir, "pages"))
    shown = F.transform("links", lambda x: F.concat_ws(" ", x["text"], x["href"]))
    return rows.select("page_id", F.array_join(shown, "|").alias("links"))


@REG.add("page_digest")
def _digest(spark, sf_dir):
    return op.page_digest(op.extract_content(fx.table(spark, sf_dir, "pages")))


@REG.add(
    "clean_web_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(replace(x, chr(160), ' '), chr(10)),
      lambda l: regexp_replace(trim(l), '[ \t]+', ' ', 'g')), chr(10)), '\n\n+', chr(10) || chr(10), 'g'), chr(10))) AS digest
    FROM (SELECT doc_id, chr(10) || replace(text, '. ', '.' || chr(160) || '  ' || chr(10) || ' ' || chr(10) || chr(10)) || chr(10) AS x FROM documents)""",
)
def _clean_web(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        r"concat('\n', replace(text, '. ', '.\u00a0  \n \n\n'), '\n') AS x",
    )
    return rows.select("doc_id", F.md5(text.clean_web(F.col("x"))).alias("digest"))


_URL_SQL = """CASE page_id % 12 WHEN 0 THEN '  ' || url WHEN 1 THEN 'HTTPS://User@' || split_part(url, '//', 2) WHEN 2 THEN 'ftp://x/' || page_id
  WHEN 3 THEN 'http://' WHEN 4 THEN 'https://files.weixin.qq.com/' || page_id WHEN 5 THEN 'https://weixin.qq.com:99999/a' WHEN 6 THEN 'https://notweixin.qq.com/'
  WHEN 7 THEN 'https://a b.example/' WHEN 8 THEN '' WHEN 9 THEN 'https://h.example:80a/' WHEN 10 THEN 'https://weixin.qq.com:8443?x=@' ELSE url END"""


@REG.add(
    "url_checks",
    f"""WITH u AS (SELECT page_id, trim({_URL_SQL}) AS u FROM pages), p AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme,
        regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1) AS auth FROM u),
    h AS (SELECT *, regexp_replace(auth, '^.*@', '') AS hp FROM p),
    k AS (SELECT *, lower(regexp_replace(hp, ':.*$', '')) AS host, CASE WHEN contains(hp, ':') THEN regexp_replace(hp, '^[^:]*:', '') ELSE '' END AS port FROM h)
    SELECT page_id, scheme IN ('http', 'https') AND host <> '' AS web, CASE WHEN u = '' THEN 'blank' WHEN contains(u, ' ') THEN 'space'
      WHEN scheme <> 'https' OR host = '' THEN 'scheme' WHEN contains(auth, '@') THEN 'userinfo'
      WHEN port <> '' AND (NOT regexp_matches(port, '^\\d+$') OR CAST(port AS INTEGER) > 65535) THEN 'port' END AS problem,
      host = 'weixin.qq.com' OR ends_with(host, '.weixin.qq.com') AS family FROM k""",
)
def _urls(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "pages").selectExpr("page_id", f"{_URL_SQL} AS u")
    url = F.col("u")
    return rows.select(
        "page_id",
        urls.is_web_url(url).alias("web"),
        urls.attachment_url_error(url).alias("problem"),
        urls.is_host_family(url, "weixin.qq.com").alias("family"),
    )


@REG.add(
    "size_gate",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_custkey * 20000 END AS r,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey * 19000 END AS p, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey * 21000 END AS a FROM orders),
    k AS (SELECT *, CASE WHEN r >= 0 THEN r END AS kr, CASE WHEN p >= 0 THEN p END AS kp FROM t)
    SELECT o_orderkey, coalesce(kr, kp, -1) AS declared, CASE WHEN kr IS NOT NULL THEN 'get-content-length' WHEN kp IS NOT NULL THEN 'head-content-length' ELSE 'stream' END AS source,
      CASE WHEN kp > 26214400 THEN 'probe_too_large' WHEN kr > 26214400 THEN 'response_too_large' WHEN a > 26214400 THEN 'received_too_large' WHEN a = 0 THEN 'empty' END AS error FROM k""",
)
def _sizes(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_custkey * 20000 END AS r",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey * 19000 END AS p",
        "CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey * 21000 END AS a",
    )
    gate = urls.size_gate(F.col("r"), F.col("p"), F.col("a"))
    return rows.withColumn("g", gate).select(
        "o_orderkey", F.coalesce("g.declared", F.lit(-1)).alias("declared"), "g.source", "g.error"
    )


_HEADERS = (
    """CASE id % 6 WHEN 0 THEN 'attachment; filename="Clip ' || id || '.MP4"' WHEN 1 THEN 'attachment; filename=photo' || id || '.png; size=1'
      WHEN 2 THEN 'attachment; filename*=UTF-8%%na%C3%AFve+' || id || '.Txt' WHEN 3 THEN 'inline' WHEN 4 THEN '' END AS disposition""",
    """CASE id % 5 WHEN 0 THEN 'Image/PNG; charset=binary' WHEN 1 THEN ' video/mp4 ' WHEN 2 THEN 'application/x-unknown-thing' WHEN 3 THEN ' ; x' END AS content_type""",
)


@REG.add(
    "attachment_names",
    f"""WITH {fx.MESSAGES_SQL}, h AS (SELECT id, CASE type WHEN 3 THEN 'image' WHEN 43 THEN 'video' ELSE 'voice' END AS media, {_HEADERS[0].replace('%%', "''''")}, {_HEADERS[1]}
      FROM messages WHERE type IN (3, 34, 43)),
    n AS (SELECT *, CASE id % 6 WHEN 0 THEN 'Clip ' || id || '.MP4' WHEN 1 THEN 'photo' || id || '.png' WHEN 2 THEN 'naïve+' || id || '.Txt' END AS name,
      coalesce(nullif(trim(split_part(content_type, ';', 1)), ''), 'application/octet-stream') AS kind FROM h),
    e AS (SELECT *, CASE WHEN name IS NOT NULL THEN lower(regexp_extract(name, '\\.[^.]*$', 0)) WHEN lower(kind) = 'image/png' THEN '.png' WHEN kind = 'video/mp4' THEN '.mp4'
      WHEN kind = 'application/octet-stream' THEN '.bin' WHEN media = 'image' THEN '.jpg' WHEN media = 'video' THEN '.mp4' ELSE '.wav' END AS extension FROM n)
    SELECT id, coalesce(name, id || extension) AS filename, kind AS content_type, extension, lower(nullif(trim(split_part(content_type, ';', 1)), '')) AS plain_type FROM e""",
)
def _names(spark, sf_dir):
    from parlance.operators.messages import with_media_type

    rows = with_media_type(fx.messages(spark, sf_dir)).selectExpr(
        "id", "media_type", _HEADERS[0].replace("UTF-8%%", "UTF-8\\'\\'"), _HEADERS[1]
    )
    named = urls.attachment_name(
        F.col("disposition"), F.col("content_type"), F.col("media_type"), F.col("id")
    )
    return rows.withColumn("n", named).select(
        "id", "n.filename", "n.content_type", "n.extension",
        urls.media_type(F.col("content_type")).alias("plain_type"),
    )
