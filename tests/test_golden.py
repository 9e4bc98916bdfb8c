"""Small literal cases of the operators."""

import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pricelore.functions import text as fn
from pricelore.operators import activity, catalog, prices, rails, reports, scheduling

LISTING = "product_id long, listing_id long, platform string, category string, price long, mrp long, stock string, match_status string, currency string, last_seen timestamp_ntz, color string"
SEEN = dt.datetime(2024, 1, 1)


def listings(spark, rows):
    full = [(1, i, p, c, price, None, stock, match, cur, SEEN, color) for i, (p, price, stock, c, match, cur, color) in enumerate(rows, 1)]
    return spark.createDataFrame(full, LISTING)


def product(spark, category="laptop", color=None):
    return spark.createDataFrame([(1, category, "b", "t", 1, "active", color)], "product_id long, category string, brand string, title string, size long, status string, color string")


def offer(p, price, stock="in_stock", c="laptop", match="matched", cur="INR", color=None):
    return (p, price, stock, c, match, cur, color)


CASES = [
    ([offer("amazon", 54990)], (54990, "amazon", 1, False)),
    ([offer("croma", 56990), offer("amazon", 54990), offer("flipkart", 55990)], (54990, "amazon", 3, False)),
    ([offer("jiomart", 49990), offer("bajajelectronics", 49990)], (None, None, 0, False)),
    ([offer("amazon", 54990), offer("flipkart", 0), offer("croma", -10), offer("reliancedigital", None), offer("jiomart", 1)], (54990, "amazon", 1, False)),
    ([offer("croma", 1999, "out_of_stock", "tws")], (1999, "croma", 1, True)),
    ([offer("amazon", 50000, "out_of_stock"), offer("croma", 55000)], (55000, "croma", 2, False)),
    ([offer("amazon", 1000, match="unmatched"), offer("flipkart", 1100, match="needs_review"), offer("croma", 54990)], (54990, "croma", 1, False)),
    ([offer("amazon", None), offer("flipkart", 0), offer("croma", 12990, match="candidate")], (None, None, 0, False)),
    ([offer("amazon", 54990, cur="USD")], (None, None, 0, False)),
    ([offer("flipkart", 100), offer("amazon", 100)], (100, "amazon", 2, False)),
]


@pytest.mark.parametrize("rows,want", CASES)
def test_best_price(spark, rows, want):
    r = prices.best_price(product(spark), listings(spark, rows)).first()
    assert (r.best_price, r.best_platform, r.platform_count, r.used_fallback) == want


def test_best_price_without_fallback(spark):
    r = prices.best_price(product(spark), listings(spark, [offer("croma", 1999, "out_of_stock")]), oos_fallback=False).first()
    assert r.best_price is None


def test_offers_collapse_to_one_a_retailer(spark):
    rows = [offer("croma", 204900, color=c) for c in ("black", "glacier", "burgundy", "white")] + [offer("flipkart", 204900, color=c) for c in ("glacier", "black")]
    rows += [offer("reliancedigital", 204900, color="burgundy"), offer("vijaysales", 205000, color="burgundy")]
    got = prices.public_offers(listings(spark, rows), product(spark, color="burgundy")).orderBy("position").collect()
    assert [r.platform for r in got] == ["croma", "flipkart", "reliancedigital", "vijaysales"]
    assert got[0].color == "burgundy"
    best = prices.best_unique_price(listings(spark, [offer("croma", 90000)] * 3 + [offer("flipkart", 91000)]), product(spark)).first()
    assert (best.best_price, best.best_platform, best.platform_count) == (90000, "croma", 2)


TIMING = [
    ([50000, 51000, 50500], [(50500, 1, 1), (51000, 1, 1)], "INSUFFICIENT_HISTORY", "INSUFFICIENT_HISTORY"),
    ([54000 + (i % 5) * 200 for i in range(19)] + [54100], [(54100, 1, 0), (54500, 1, 0)], "CONSIDER_NOW", "NEAR_RECENT_LOW"),
    ([50000] + [58000] * 20, [(58000, 1, 1), (58500, 1, 1)], "WAIT_FOR_BETTER_PRICE", "ABOVE_RECENT_LOW"),
    ([50000] + [58000] * 18 + [56000], [(56000, 1, 1), (57000, 1, 1)], "WATCH", "RECENT_DROP_ABOVE_LOW"),
    ([50000] * 20, [(50000, 0, 1)], "UNAVAILABLE", "OOS_ONLY"),
    ([54100] * 20, [(54100, 1, 80), (54100, 1, 80)], "WATCH", "STALE_OFFERS"),
    ([54100] * 20, [(54100, 1, 1)], "WATCH", "WATCH"),
    ([54100] * 20, [], "UNAVAILABLE", "NO_PRICED_OFFERS"),
]


@pytest.mark.parametrize("history,offers,state,code", TIMING)
def test_timing(spark, history, offers, state, code):
    end = dt.date(2024, 3, 1)
    daily = spark.createDataFrame([(1, end - dt.timedelta(days=len(history) - 1 - i), p * 100) for i, p in enumerate(history)], "product_id long, day date, price long")
    stats = prices.window_stats(daily, "2024-03-01", {"90d": 90, "tracked": 3650})
    names = ("amazon", "croma", "flipkart")
    rows = [(1, i, names[i], "laptop", p * 100, None, "in_stock" if s else "out_of_stock", "matched", "INR", dt.datetime(2024, 3, 1) - dt.timedelta(hours=h), None) for i, (p, s, h) in enumerate(offers)]
    got = prices.timing(product(spark), prices.offer_state(spark.createDataFrame(rows, LISTING), "2024-03-01 00:00:00"), stats).first()
    assert (got.state, got.code) == (state, code)


def test_window_stats_drop_bad_prices(spark):
    rows = [(1, dt.date(2024, 1, d), p) for d, p in ((1, 0), (2, -10), (3, 55000))]
    got = prices.window_stats(spark.createDataFrame(rows, "product_id long, day date, price long"), "2024-01-31", {"30d": 30}).first()
    assert (got.n, got.low, got.volatility, got.percentile) == (1, 55000, None, None)


def test_insight(spark):
    def label(history, price):
        rows = [(1, dt.date(2024, 1, 1 + i), p) for i, p in enumerate(history)]
        daily = spark.createDataFrame(rows, "product_id long, day date, price long")
        return prices.insight(daily, spark.createDataFrame([(1, price)], "product_id long, price long")).first().label

    assert label([100, 120, 140], 101) == "Near observed low"
    assert label([100, 110, 120], 150) == "Above recent average"
    assert label([100, 110], 100) == "Limited data"


def test_trending_needs_growth(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [(1, now - dt.timedelta(hours=5), 5), (1, now - dt.timedelta(hours=60), 8), (2, now - dt.timedelta(hours=5), 6), (2, now - dt.timedelta(hours=60), 1)]
    hours = spark.createDataFrame(rows, "product_id long, hour timestamp_ntz, n long")
    got = activity.trending(hours, "2024-01-10 00:00:00").collect()
    assert [(r.product_id, r.recent, r.baseline, r.momentum) for r in got] == [(2, 6, 1, 6.0)]


def test_activity_counts_a_client_once_an_hour(spark):
    at = dt.datetime(2024, 1, 1, 5, 10)
    rows = [(1, at, 7, "view", 1), (2, at, 7, "view", 1), (3, at, None, "view", 1), (4, at, None, "view", 1), (5, at + dt.timedelta(hours=1), 7, "view", 1)]
    got = activity.hourly(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, client_id long, event_type string, product_id long")).orderBy("hour").collect()
    assert [r.n for r in got] == [3, 1]


PAGES = [
    ([["a", "b"], ["a"], ["b"], ["a", "b"]], 4, "consecutive_no_new"),
    ([["a"], ["a"]], 2, "repeated_page"),
    ([["a"], []], 2, "empty_page"),
]


@pytest.mark.parametrize("pages,page,stop", PAGES)
def test_saturation(spark, pages, page, stop):
    rows = [("r", n, i) for n, ids in enumerate(pages, 1) for i in (ids or [None])]
    got = {r.page_no: r for r in rails.saturation(spark.createDataFrame(rows, "run_id string, page_no long, native_id string")).collect()}
    assert got[page].stop == stop


def test_saturation_counts_new_ids_and_has_a_ceiling(spark):
    rows = [("r", 1, "a"), ("r", 1, "b"), ("r", 2, "b"), ("r", 2, "c"), ("s", 40, "x")]
    got = {(r.run_id, r.page_no): r for r in rails.saturation(spark.createDataFrame(rows, "run_id string, page_no long, native_id string")).collect()}
    assert (got["r", 2].n_new, got["r", 2].n_again) == (1, 1) and got["s", 40].stop == "emergency_ceiling"


def test_diverse_takes_turns(spark):
    rows = [(i, "a", i) for i in range(6)] + [(10, "b", 1), (11, "b", 2), (20, "c", 1)]
    got = rails.diverse(spark.createDataFrame(rows, "product_id long, category string, score int"), [F.asc("score")], 7, cap=2).orderBy("position").collect()
    assert [(r.category, r.product_id) for r in got] == [("a", 0), ("b", 10), ("c", 20), ("a", 1), ("b", 11), ("a", 2), ("a", 3)]


def test_sections_keep_first_and_refill(spark):
    rows = [(1, i, i) for i in range(1, 6)] + [(2, 1, 1), (2, 2, 2), (2, 3, 9), (2, 4, 3)]
    got = rails.first_section(spark.createDataFrame(rows, "rail int, position int, product_id int")).where("rail = 2").orderBy("position").collect()
    assert [(r.product_id, r.fresh) for r in got] == [(1, False), (2, False), (9, True)]


def test_watch_events(spark):
    events = [(1, "drop", 49000_00, 50000_00, "in_stock"), (2, "drop", 9950_00, 10000_00, "in_stock"), (3, "drop", 390_00, 500_00, "in_stock"), (4, "rise", 51000_00, 50000_00, "in_stock"), (5, "out_of_stock", 45000_00, 45000_00, "out_of_stock")]
    frame = spark.createDataFrame(events, "product_id long, kind string, price long, previous long, stock string")
    watches = spark.createDataFrame([(9, i, 50000_00 if i == 5 else 1, True) for i in range(1, 6)], "user_id long, product_id long, target long, notify_on_drop boolean")
    got = {(r.product_id, r.event) for r in reports.watch_events(watches, frame.unionByName(frame)).collect()}
    assert got == {(1, "PRICE_DROP"), (3, "PRICE_DROP"), (5, "OUT_OF_STOCK")}


@pytest.mark.parametrize("text,want", [("Currently unavailable... Add to Cart", "in_stock"), ("delivery: not available in your area", "unknown"), ("Currently unavailable.", "out_of_stock"), ("robot check captcha", "challenge")])
def test_stock_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fn.stock_of(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    "title,want",
    [("Canon Camera Bag for EOS R10", "accessory"), ("Tempered Glass Screen Protector for iPhone 16", "accessory"), ("LG Soundbar for TV, 2.1 Channel", "headphones"), ("Sony WF-1000XM5 True Wireless Earbuds", "tws"), ("Canon EOS R10 Body Only", "camera"), ("Samsung 55 inch 4K UHD Smart LED TV", "television")],
)
def test_category(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(fn.category_of(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("q,low,high", [("gaming laptop under 70000", None, 70000), ("phone between 10k and 2 lakh", 10000, 200000), ("ANC earbuds under 5k", None, 5000), ("WH-1000XM5", None, None), ("tv above 1.5 lakh", 150000, None)])
def test_price_intent(spark, q, low, high):
    r = spark.createDataFrame([(q,)], "q string").select(fn.price_intent(F.col("q")).alias("i")).first().i
    assert (r.low, r.high) == (low, high)


@pytest.mark.parametrize("q,c,t,want", [("gaming laptop", "laptop", "asus rog rtx 4060", 48.0), ("gaming laptop", "laptop", "samsung galaxy book5", -36.0), ("oled tv", "television", "lg oled c4", 24.0), ("samsung tv", "television", "samsung crystal", 0.0)])
def test_intent_score(spark, q, c, t, want):
    assert spark.createDataFrame([(q, c, t)], "q string, c string, t string").select(fn.intent_score(F.col("q"), F.col("c"), F.col("t"))).first()[0] == want


@pytest.mark.parametrize("url,want", [("HTTPS://WWW.Amazon.in//dp/B01/?tag=x&utm_source=y&th=1#frag", "https://www.amazon.in/dp/B01?th=1"), ("http://a.com/?ref=1", "http://a.com"), ("http://a.com/x?b=2&a=1", "http://a.com/x?b=2&a=1")])
def test_normalise_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(fn.normalise_url(F.col("u"))).first()[0] == want


def test_roots_follow_chains_and_loops(spark):
    rows = [(1, None), (2, 1), (3, 2), (10, 11), (11, 10)]
    got = {r.product_id: (r.root, r.depth, r.looped) for r in catalog.resolve_roots(spark.createDataFrame(rows, "product_id long, duplicate_of long"), 5).collect()}
    assert got[3] == (1, 2, False) and got[1] == (1, 0, False) and got[10][2] and got[11][2]


def test_breaker_opens_and_closes(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(hours=h), "p", ok) for i, (h, ok) in enumerate([(0, False), (1, False), (2, False), (3, True), (9, True), (10, False)])]
    r = scheduling.circuit_breaker(spark.createDataFrame(rows, "check_id long, ts timestamp_ntz, platform string, ok boolean")).first()
    assert (r.state, r.streak, r.opened, r.skipped, r.n) == ("closed", 1, 1, 1, 6)


def test_similarity_of_trigrams(spark):
    row = spark.createDataFrame([("word", "two words")], "a string, b string").select(catalog.similarity(catalog.trigrams(F.col("a")), catalog.trigrams(F.col("b"))).alias("s")).first()
    assert row.s == pytest.approx(4 / 11)


TITLE_NOISE = re.compile(
    r"\b(laptop|notebook|computer|pc|anti[\s-]?glare|backlit|thin|light|ultra[\s-]?slim|gaming|portable|slim|premium|business|standard|smartchoice|"
    r"silver|black|grey|gray|blue|gold|natural|starry|midnight|moonlight|graphite|titanium|platinum|arctic|cool|mixed|mica|glacier|previously|powered\s+by|"
    r"windows\s*\d*|home|office|microsoft|ms\b|with|for|and|the|best|new|latest|full\s*hd|fhd|wuxga|oled|ips|display|screen|inch|cm|kg)\b"
)


def plain_title(text):
    t = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower().replace("&", " and ")
    return re.sub(r"\s+", " ", TITLE_NOISE.sub(" ", re.sub(r"[^\w\s\-.]", " ", t)).strip())


def test_titles_equal_a_plain_version(spark):
    rng = random.Random(5)
    words = ["HP", "Pavilion", "Laptop", "windows 11", "Full  HD", "anti-glare", "anti glare", "Ultra-Slim", "powered\tby", "15.6", "inch", "(2023)", "R&D", "&", "Ñandú", "écran", "Größe", "_x_", "a+b", "中文", "–", "ＷＩＤＥ", "ms", "MSI", "cm", "\x1c", " ", "i5-12450H", "'s", "½x", "naïve"]
    given = ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "-", "/", ","]) for _ in range(rng.randrange(8))).replace("½", "") for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", fn.normalise_title(F.col("t")).alias("x"), fn.title_tokens(F.col("t")).alias("y")).orderBy("i").collect()
    assert [r.x for r in rows] == [plain_title(t) for t in given]
    assert [r.y for r in rows] == [sorted({w for w in plain_title(t).split() if len(w) >= 2}) for t in given]


def test_tracking_parameters_fall(spark):
    given = ["https://www.amazon.in/dp/B0ABCDE123?tag=x", "https://www.amazon.in/dp/B0ABCDE123", "HTTPS://Shop.in//a//b/?srsltid=1&PID=5&utm_x=3&affid=7&otracker=z", "https://x.in/?qH=1"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", fn.normalise_url(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == ["https://www.amazon.in/dp/B0ABCDE123"] * 2 + ["https://shop.in/a/b?PID=5&affid=7", "https://x.in?qH=1"]
