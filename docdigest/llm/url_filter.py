"""URL filters that follow redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdigest.llm.common import cut
from docdigest.llm.components import connected_components

# The rules, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it: a plan grows with what it says, not with what it says again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none does. Of rules of one length an allow comes first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _address(url: Column) -> Column:
    """What aliases are compared by: the URL without scheme and fragment."""
    return F.concat(host_of(url), F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1))


def _unescaped(c: Column) -> Column:
    """Text with character references decoded: numbers (U+FFFD for what is no character), and the names of what stands in addresses."""
    names = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "period": ".", "quest": "?", "equals": "=", "num": "#", "percnt": "%"}

    signs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def number(digits: Column) -> Column:
        value = F.conv(digits, 16, 10).cast("long")
        valid = _let(value, lambda v: v.between(1, 0x10FFFF) & ~v.between(0xD800, 0xDFFF))
        return F.decode(F.unhex(F.lpad(F.when(valid, digits).otherwise("FFFD"), 8, "0")), "UTF-32")

    def sign(name: Column) -> Column:
        digits = F.when(F.lower(name).startswith("#x"), F.substring(name, 3, 6)).otherwise(F.conv(F.substring(name, 2, 7), 10, 16))
        return F.when(name.startswith("#"), _let(digits, number)).otherwise(signs[name])

    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-z]+);", 1)
        decoded = _let(name, lambda n: F.concat(F.when(n != "", sign(n)), F.substr(part, F.length(n) + 2)))
        return F.when(i == 0, part).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), part)))

    return _let(c, lambda c: F.when(c.contains("&"), F.array_join(F.transform(F.split(c, "&"), one), "")).otherwise(c))


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` parts are resolved."""
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1))).otherwise(F.concat(done, F.array(part)))
    whole = lambda parts: F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    ended = lambda parts: F.concat(whole(parts), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return _let(path, lambda p: F.when(p.rlike(r"/\.{1,2}(/|$)"), _let(F.split(p, "/"), ended)).otherwise(p))


def resolved(target: Column, base: Column) -> Column:
    """The absolute address of a link's target on a page of the address ``base``; null for what is none, such as a place on the page."""

    def joined(own: Column, rest: Column, path: Column) -> Column:
        folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
        whole = _without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)))
        return F.when(own == "", F.when(rest.startswith("?"), F.concat(path, rest))).otherwise(F.concat(whole, rest))

    def relative(target: Column, at: Column) -> Column:
        parts = F.struct(F.regexp_extract(target, r"^([^?#]*)", 1).alias("own"), F.regexp_extract(target, r"^[^?#]*(.*)$", 1).alias("rest"), path_of(at).alias("path"))
        return _let(parts, lambda x: joined(x["own"], x["rest"], x["path"]))

    def one(x: Column) -> Column:
        t, at = x["target"], x["base"]
        own = F.when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), t).when(t.startswith("//"), F.concat(F.lit("http:"), t))
        here = _let(host_of(at), lambda host: F.when(host != "", F.concat(F.lit("http://"), host, relative(t, at))))
        return F.coalesce(own, F.when(~t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), here))

    return _let(F.struct(target.alias("target"), base.alias("base")), one)


def links_of(url: Column, html: Column) -> Column:
    """Absolute targets of a page's canonical links and redirects (meta refresh), resolved against its address or its ``base``; comments do not count."""
    href = lambda t: F.regexp_extract(t, r"""(?i)[\s"']href\s*=\s*["']?\s*([^\s"'<>]+)""", 1)

    def found(tags: Column) -> Column:
        canonical = F.filter(tags, lambda t: t.rlike(r"""(?i)^<link\b[^<>]*[\s"']rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""))
        refresh = F.filter(tags, lambda t: t.rlike(r"""(?i)^<meta\b[^<>]*[\s"']http-equiv\s*=\s*["']?refresh\b"""))
        bases = F.filter(F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<base\b")), href), lambda t: t != "")
        targets = F.concat(F.transform(canonical, href), F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^\s"'<>]+)""", 1)))
        base = F.coalesce(resolved(_unescaped(F.get(bases, F.lit(0))), url), url)
        absolute = lambda at: F.transform(F.filter(targets, lambda t: t != ""), lambda t: resolved(_unescaped(t), at))
        return F.filter(_let(base, absolute), lambda t: t.isNotNull())

    tags = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", ""), F.lit(r"(?i)<(?:link|meta|base)\b[^<>]*>"), F.lit(0))
    return F.when(html.rlike("(?i)canonical|refresh"), _let(tags, found))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each row of ``pages(page_id, url, html)``.

    A URL's own rule decides. Without one, the URL is judged with its aliases: all that canonical links and redirects, those of
    the pages and those of ``redirects(source, target)``, connect it with. One alias that a rule allows makes it allowed;
    else one that a rule blocks makes it blocked; else it is allowed. URLs are compared without scheme and fragment; targets
    may be relative, to the page or to its ``base``.
    Null URLs and such without ``://`` have empty hosts and paths, no rule and no alias. Only built-in functions run.
    """
    url = F.col("url").cast("string")
    edges = pages.select(_address(url).alias("a"), F.explode(links_of(url, F.col("html"))).alias("t")).select("a", _address(F.col("t")).alias("b"), "t")
    if redirects is not None:
        edges = edges.union(redirects.select(_address(F.col("source")), _address(F.col("target")), "target"))
    edges = cut(edges.where("a != '' and b != '' and a != b").distinct())
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), _address(url).alias("address"))
    rows = rows.withColumn("rule", rule).withColumn("own", verdict)
    if edges.isEmpty():  # no URL has an alias
        return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    names = cut(edges.select(F.col("a").alias("address")).union(edges.select("b")).distinct())
    of = connected_components(edges, native=True)
    at = F.concat(F.lit("x://"), F.col("address"))
    _, decided = rule_for(host_of(at), path_of(at), rules)
    judged = names.join(of, F.col("address") == F.col("node"), "left").select("address", F.coalesce("component", "address").alias("group"), decided.alias("own"))
    groups = judged.groupBy("group").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    groups = cut(groups.where("blocked and not coalesce(allowed, false)").select("group"))
    blocked = cut(judged.join(groups, "group", "left_semi").select(F.col("address").alias("alias"), F.lit("block").alias("by_alias")))
    found = rows.join(blocked, F.col("address") == F.col("alias"), "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("own", "by_alias", F.lit("allow")).alias("verdict"))
