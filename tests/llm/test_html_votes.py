"""The vote of a host's pages decides, and pages made of known parts give the known text."""

import random

from gridlode.llm import html_extract

WORDS = "river stone house bridge winter letter market garden captain window harvest valley".split()
AROUND = [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "<header><h1>The Site</h1></header>", "<footer>All rights reserved</footer>", "<div class='sidebar'><p>Most read today</p></div>", "<div class='cookie-notice'>We use cookies here.</div>",
    "<form action=/s><input name=q><label>Search</label></form>", "<script>var a = '<p>no text</p>';</script>", "<style>p { color: red }</style>", "<div class='ad-box'>Buy these shoes now</div>", "<section id='comments'><p>Nice text, thank you very much for it!</p></section>", "<!-- <p>hidden</p> -->",
]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def made(rng, wrapper):
    """A page and its text."""
    parts, text = [], []
    for _ in range(rng.randrange(2, 6)):
        said = sentence(rng, rng.randrange(12, 40))
        text.append(said)
        first, rest = said.split(" ", 1)
        parts.append(rng.choice([f"<p>{said}</p>", f"<p><b>{first}</b>\n  {rest}", f"<h2>{said}</h2>", f"<p>{said.replace(' ', '&#32;')}</p>", f"<blockquote>{said}</blockquote>"]))
    around = rng.sample(AROUND, rng.randrange(2, 7))
    cut = rng.randrange(len(around))
    return f"<html><head><title>T</title></head><body>{''.join(around[:cut])}<div class='{wrapper}'>{''.join(parts)}</div>{''.join(around[cut:])}</body></html>", " ".join(text)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_of_known_parts(spark):
    rng = random.Random(6)
    made_ = [made(rng, ("post-body", "entry", "c12")[i % 3]) for i in range(90)]
    out = html_extract.main_text(pages_of(spark, [(i, f"http://{'abc'[i % 3]}.org/{i}", h) for i, (h, _) in enumerate(made_)]))
    assert {r.page_id: r.text for r in out.collect()} == {i: t for i, (_, t) in enumerate(made_)}


TEXT = "The council met on Monday to talk of the bridge that the flood took away in the spring."
MORE = "Work is to begin in autumn, and the road by the mill stays closed until it is done, they said."
BLURB = "Readers of this paper also know how much it costs to send a letter to the other side of the sea."
PAGE = "<body><div class='post'><p>%s</p><p>%s</p></div>%s</body>"


def test_the_vote_changes_an_odd_page(spark):
    blurb = f"<div class='blurb'><p>{BLURB}</p></div>"
    plain = [(i, f"http://a.org/{i}", PAGE % (TEXT, MORE, "")) for i in range(6)]
    odd = (10, "http://a.org/odd", PAGE % (TEXT, MORE, blurb))
    text = lambda rows: {r.page_id: r.text for r in html_extract.main_text(pages_of(spark, rows)).collect()}
    assert text([odd])[10] == f"{TEXT} {MORE} {BLURB}"  # alone it takes what is clean
    assert text([*plain, odd])[10] == f"{TEXT} {MORE}"
    # a blurb larger than the article doesn't win either, where the article is as long as usual
    large = (11, "http://a.org/large", PAGE % (TEXT, MORE, f"<div class='blurb'><p>{BLURB} {BLURB} {BLURB}</p></div>"))
    assert text([*plain, large])[11] == f"{TEXT} {MORE}"


def test_pages_without_the_path_keep_their_own(spark):
    plain = [(i, f"http://a.org/{i}", PAGE % (TEXT, MORE, "")) for i in range(6)]
    other = (10, "http://a.org/x", f"<body><div class='story'><p>{BLURB}</p><p>{MORE}</p></div></body>")
    short = (11, "http://a.org/y", f"<body><div class='post'><p>In short.</p></div><div class='story'><p>{BLURB}</p><p>{MORE}</p><p>{TEXT}</p></div></body>")
    empty = (12, "http://a.org/z", f"<body><div class='post'></div><div class='story'><p>{BLURB}</p></div></body>")
    elsewhere = (13, "http://b.org/z", PAGE % (TEXT, MORE, f"<div class='blurb'><p>{BLURB}</p></div>"))
    got = {r.page_id: r.text for r in html_extract.main_text(pages_of(spark, [*plain, other, short, empty, elsewhere])).collect()}
    assert got[10] == f"{BLURB} {MORE}" and f"{BLURB} {MORE} {TEXT}" in got[11] and got[12] == BLURB
    assert got[13] == f"{TEXT} {MORE} {BLURB}"  # another host's vote


def test_equal_votes_take_the_first_path(spark):
    rows = [(1, "http://a.org/1", f"<body><div class='b'><p>{TEXT}</p></div></body>"), (2, "http://a.org/2", f"<body><div class='a'><p>{TEXT}</p></div></body>")]
    won = html_extract.winning_paths(pages_of(spark, rows), "url", "html").collect()
    assert [r.path for r in won] == [min(html_extract.path_of("/body/div.a"), html_extract.path_of("/body/div.b"))] and won[0].usual == len(TEXT)
