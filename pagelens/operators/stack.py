"""Which platform a page runs on, and the addresses a crawler should leave out there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals of each platform as (weight, where, text), platforms in order of preference.
SIGNALS: dict[str, list[tuple[int, str, str]]] = {
    "wordpress": [
        (5, "html", "/wp-content/"), (4, "html", "/wp-includes/"), (5, "html", "/wp-json"), (3, "html", "wp-emoji"), (4, "html", "api.w.org"),
        (3, "header", "x-pingback:"), (5, "gen", "wordpress"),
    ],
    "shopify": [
        (6, "header", "x-shopify-stage:"), (6, "header", "x-shopid:"), (5, "header", "x-shardid:"), (5, "html", "cdn.shopify.com"),
        (4, "html", "shopify.theme"), (5, "html", "myshopify.com"), (4, "html", "/cdn/shop/"),
    ],
    "wix": [
        (6, "header", "x-wix-request-id:"), (5, "html", "static.wixstatic.com"), (4, "html", "wix.com"), (4, "html", "_wixcssstates"), (5, "gen", "wix.com"),
    ],
    "squarespace": [
        (5, "html", "static1.squarespace.com"), (5, "html", "squarespace-cdn.com"), (4, "html", "squarespace.com"), (6, "gen", "squarespace"),
        (4, "header", "x-servedby:"),
    ],
    "webflow": [
        (5, "html", "assets.website-files.com"), (5, "html", "assets-global.website-files.com"), (4, "html", "data-wf-page"), (3, "html", "webflow.js"),
        (6, "gen", "webflow"),
    ],
    "framer": [(6, "html", "framerusercontent.com"), (4, "html", "framer.com"), (4, "re", "__framer"), (6, "gen", "framer")],
    "nextjs": [
        (6, "re", "__NEXT_DATA__"), (5, "html", "/_next/static"), (4, "html", 'id="__next"'), (5, "header", "x-powered-by: next.js"), (3, "header", "x-nextjs-"),
    ],
    "react": [(3, "html", "data-reactroot"), (3, "re", r"react(?:-dom)?(?:\.production)?\.min\.js"), (2, "re", "__reactContainer")],
    "laravel": [(6, "cookie", "laravel_session"), (4, "cookie", "xsrf-token"), (3, "header", "x-powered-by: php")],
    "drupal": [
        (5, "re", r"Drupal\.settings"), (4, "html", "/sites/default/files"), (4, "html", "/sites/all/"), (3, "html", "data-drupal"),
        (6, "header", "x-generator: drupal"), (6, "gen", "drupal"),
    ],
    "joomla": [(5, "html", "/media/jui/"), (4, "html", "/media/system/js/"), (4, "html", "option=com_"), (6, "gen", "joomla")],
    "magento": [(5, "html", "/static/version"), (4, "html", "/mage/"), (4, "re", "Magento_"), (5, "cookie", "x-magento"), (5, "header", "x-magento-")],
    "ghost": [(6, "gen", "ghost"), (4, "html", "/content/images/"), (3, "html", "ghost-"), (4, "re", 'name="generator" content="Ghost')],
}
#: Marks of a shop.
SHOP_SIGNALS = ("/plugins/woocommerce/", "woocommerce-", "wc-block", "add-to-cart")
#: Addresses without value for a crawl, by platform and kind of site.
EXCLUDES = {
    "wordpress": ["/wp-admin/", "/wp-includes/", "/wp-json/", "/xmlrpc.php", "/wp-login.php", "/wp-content/plugins/", "/wp-content/themes/", "/feed/?$", "/trackback/", "/cgi-bin/", r"\?replytocom"],
    "wordpress/woocommerce": ["/cart/", "/checkout/", "/my-account/", r"\?add-to-cart=", r"\?orderby=", r"\?wc-ajax=", r"\?filter_", "/wishlist/"],
    "wordpress/blog": ["/tag/", "/author/", r"/page/\d+"],
    "wordpress/saas": ["/login/", "/signup/", "/register/", "/dashboard/", "/app/", "/account/"],
    "shopify": ["/cart", "/checkout", "/account", "/apps/", "/tools/", "/a/", r"\?variant=", r"\?sort_by=", r"/collections/.+\?", "/cdn/"],
    "webflow": ["/404", "/401", "/detail_"],
    "nextjs": ["/_next/", "/api/", "/static/"],
    "react": ["/static/", "/assets/", "/api/"],
    "laravel": ["/storage/", "/vendor/", "/login", "/register", "/password", "/admin", r"\?page="],
    "drupal": ["/admin", "/user", "/node/add", r"\?q=", "/sites/default/files/"],
    "joomla": ["/administrator/", r"\?task=", r"index\.php\?option="],
    "magento": ["/checkout/", "/customer/", "/catalogsearch/", r"\?SID=", r"\?p=", "/wishlist/"],
    "squarespace": ["/config", r"\?format=", r"\?category="],
    "wix": ["/_partials/", r"\?lightbox="],
    "ghost": ["/ghost/", "/tag/", "/author/", "/rss/"],
}


def excludes(stack: str, kind: str = "") -> list[str]:
    """Patterns of a platform and a kind of site there."""
    return list(dict.fromkeys([*EXCLUDES.get(stack, []), *EXCLUDES.get(f"{stack}/{kind}", [])]))


def fingerprint(pages: DataFrame) -> DataFrame:
    """(crawl_id, url, stack, subcategory, confidence, signals) per page; generic without any signal.

    Weights of the signals found are summed per platform inside the row; the largest sum wins, on a tie
    the platform named first.
    """
    low = F.lower("html")
    blob = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit(": "), F.lower(e["value"]))), "\n")
    cookie = F.lower(F.coalesce(F.col("headers")["set-cookie"], F.lit("")))
    generator = F.lower(F.regexp_extract("html", r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']""", 1))
    rows = pages.select("crawl_id", "url", "html", low.alias("_low"), blob.alias("_blob"), cookie.alias("_cookie"), generator.alias("_gen"))

    def found(where: str, text: str) -> Column:
        if where == "re":
            return F.col("html").rlike(text)
        return F.contains({"html": F.col("_low"), "header": F.col("_blob"), "cookie": F.col("_cookie"), "gen": F.col("_gen")}[where], F.lit(text))

    stacks = []
    for place, (name, signals) in enumerate(SIGNALS.items()):
        hits = F.array_compact(F.array(*[F.when(found(k, t), F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"))) for w, k, t in signals]))
        score = F.aggregate(hits, F.lit(0), lambda s, h: s + h["w"])
        most = min(sum(w for w, _, _ in signals), 10)
        stacks.append(
            F.struct(
                score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("stack"), F.transform(hits, lambda h: h["t"]).alias("signals"), F.lit(most).alias("most")
            )
        )
    shop = F.lit(False)
    for t in SHOP_SIGNALS:
        shop = shop | found("html", t)
    best = rows.select("crawl_id", "url", F.array_max(F.array(*stacks)).alias("b"), shop.alias("shop"))
    some = F.col("b.score") > 0
    return best.select(
        "crawl_id",
        "url",
        F.when(some, F.col("b.stack")).otherwise("generic").alias("stack"),
        F.when(some & (F.col("b.stack") == "wordpress") & F.col("shop"), "woocommerce").otherwise("").alias("subcategory"),
        F.when(some, F.bround(F.least(F.lit(1.0), F.col("b.score") / F.col("b.most")), 2)).otherwise(0.0).alias("confidence"),
        F.when(some, F.col("b.signals")).otherwise(F.array().cast("array<string>")).alias("signals"),
    )
