import random
import re

from tidewatch.llm import urlfilter as u

RULES = [u.parse_rule(r) for r in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def test_verdicts(spark):
    rows = [
        (1, "https://Blog.Example.ORG/es/5?q", "allow"),
        (2, "http://example.org", "x"),
        (3, "http://a.example.org/en/12#t", "x"),
        (4, "http://www.casino-win.example.net/en/1", "x"),
        (5, "http://cheap.example.net/pills", "x"),
        (6, "http://cheap-cheap.example.net/", "x"),
        (7, "http://cheapest.example.net/casinos", "x"),
        (8, None, "x"),
        (9, "", "x"),
        (9, "nothing", "x"),
        (10, "x://notorg/" + "a" * 100000, "x"),
        (11, "http://shop.com/de/casino", "x"),
    ]
    got = sorted((r.page_id, r.rule, r.verdict) for r in u.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect())
    assert [g for g in got if g[0] != 10] == [
        (1, "example.org/es/", "block"),
        (2, None, "allow"),
        (3, "example.org/en/1", "block"),
        (4, None, "block"),
        (5, None, "block"),
        (6, None, "allow"),
        (7, None, "allow"),
        (8, None, "allow"),
        (9, None, "allow"),
        (9, None, "allow"),
        (11, "com/de/", "block"),
    ]
    assert (10, None, "allow") in got
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_the_whole_url_is_judged(spark):
    rows = [
        ("http://x.net/search?q=casino", "", "block"),
        ("http://x.net/#PORN", "", "block"),
        ("casino.example/xxx", None, "block"),
        ("http://x.net/cheap?for=pills", "", "block"),
        ("http://x.net/cheap?for=cheap#cheap", "", "allow"),
        ("http://x.net/?q=casinos", "", "allow"),
        ("https://example.org/?q=casino", "org/", "allow"),
        ("plain words", None, "allow"),
    ]
    got = u.filter_urls(spark.createDataFrame([(i, url) for i, (url, _, _) in enumerate(rows)], "page_id long, url string"), RULES).collect()
    assert {r.page_id: r.verdict for r in got} == {i: verdict for i, (_, _, verdict) in enumerate(rows)}
    assert {r.page_id: r.rule for r in got} == {i: rule or None for i, (_, rule, _) in enumerate(rows)}
    assert got[2].host == got[2].path == "" and {r.host for r in got[:2]} == {"x.net"} and got[0].path == "/search"


def plain(url, terms, limit):
    """The verdict by looking for each term by itself."""
    text = "".join(c.lower() if c.isascii() else c for c in url or "")
    words = {}
    for term, n in terms:
        before, after = "" if term[0] == "*" else "(?<![a-z0-9])", "" if term[-1] == "*" else "(?![a-z0-9])"
        if re.search(before + re.escape(term.strip("*")) + after, text):
            words[term.strip("*")] = max(n, words.get(term.strip("*"), 0))
    return "block" if sum(words.values()) >= limit else "allow"


ORDINARY = """essex.gov/adult/education/credit bank.com/mortgage/loan x.org/best/free/online news.net/sport/live-stream/watch
uni.edu/library/patch/serial shop.com/outlet/sale/deals-of-the-day farm.org/track-record/seeds.html health.gov/pharmacy/prescription
museum.org/prize-winner/2020 city.gov/parking/offers?order=top sussex.ac.uk/adult-learning/download blog.net/2019/05/how-i-track-my-debt
middlesexhospital.org/escorting scunthorpe.co.uk/history games.org/poker/rules essays.com/lottery-by-jackson docs.dev/api/redirect?track=off
credit-union.org/loans/options bookshop.com/hot/new/best x.com/assassins/guide""".split()
UNWANTED = """freeporn.com x.com/pornhub best-hentai.example videos.net/xxx/live online-casino.example grandcasino.example/en
buyviagra.example cheap-viagra.example/rx hot-bets.example/poker win-prizes.example/giveaway/spam softwarez.example/crack getkeygen.example
payday-loans.example/cash free-torrents.example/cracked adult-dating.example/strip/odds""".split()


def test_ordinary_urls_pass_and_compound_ones_do_not(spark):
    pages = spark.createDataFrame([(i, "http://" + url) for i, url in enumerate(ORDINARY + UNWANTED)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in u.filter_urls(pages, []).collect()}
    wrong = [url for i, url in enumerate(ORDINARY + UNWANTED) if got[i] != ("allow" if i < len(ORDINARY) else "block")]
    assert wrong == []


def test_a_vocabulary_is_learned_from_judged_urls(spark):
    rng = random.Random(6)
    bad, both, good = ([f"{kind}{i}" for i in range(n)] for kind, n in (("bad", 400), ("mid", 100), ("good", 400)))
    def url(blocked):
        words = [rng.choice(bad if blocked else good), rng.choice(both), rng.choice(good), rng.choice(bad if rng.random() < (0.3 if blocked else 0.002) else both)]
        rng.shuffle(words)
        return "http://" + ".".join(words[:2]) + ".com/" + "/".join(words[2:]), blocked
    rows = [url(int(i % 4 == 0)) for i in range(24_000)] + [(None, 1), ("http://x.com", None)]
    terms = dict(u.learn_terms(spark.createDataFrame(rows[:20_000] + rows[-2:], "url string, blocked int")))
    assert 350 < len(terms) <= 400 and all(t.startswith("bad") for t in terms) and max(terms.values()) == u.LIMIT
    held = spark.createDataFrame([(i, url) for i, (url, _) in enumerate(rows[20_000:-2])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in u.filter_urls(held, [], terms=tuple(terms.items())).collect()}
    right = [(got[i] == "block") == bool(b) for i, (_, b) in enumerate(rows[20_000:-2])]
    assert sum(right) > 0.95 * len(right)
    assert u.learn_terms(spark.createDataFrame([], "url string, blocked int")) == () == u.learn_terms(spark.createDataFrame([("http://a.b", 0)], "url string, blocked int"))


def test_vocabulary_is_a_plain_search(spark):
    terms = u.vocabulary()
    assert 150 < len(terms) < 260 and {n for _, n in terms} == {1, 2, 3, 6}
    rng = random.Random(2)
    words = [w.strip("*") for w, _ in terms] + ["news", "garden", "bookshelf", "casinos2", "é"]
    rows = []
    for i in range(1500):
        text = "".join(rng.choice(words) + rng.choice(["-", "/", ".", "x", "_", "?", "=", "É"]) for _ in range(rng.randrange(4)))
        rows.append((i, rng.choice(["http://a.example.net/", "", "HTTP://B.com/"]) + (text.upper() if i % 7 == 0 else text)))
    for limit in (6, 4):
        got = {r.page_id: r.verdict for r in u.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [], limit=limit).collect()}
        assert got == {i: plain(url, terms, limit) for i, url in rows} and len(set(got.values())) == 2


def test_a_file_of_terms(spark, tmp_path):
    (tmp_path / "terms").write_text("# none: x\n6: Alpha\n\n2: beta gamma alpha\n3: beta\n")
    assert u.vocabulary(str(tmp_path / "terms")) == (("alpha", 6), ("beta", 3), ("gamma", 2))
    pages = spark.createDataFrame([(1, "http://alpha.x"), (2, "http://beta.gamma"), (3, "http://casino.x")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in u.filter_urls(pages, [], terms=(("alpha", 6), ("beta", 3), ("gamma", 2))).collect()) == [(1, "block"), (2, "allow"), (3, "allow")]
    assert {r.verdict for r in u.filter_urls(pages, [], terms=()).collect()} == {"allow"}
