"""Main text of web pages: the best-scoring contiguous run of a page.

A page is a sequence of text pieces and tags.  Words score positive, tags negative, by weights that
depend on the open elements around them (their names, and the words of their class and id); the weights
are log-odds counted on labelled pages.  One linear scan finds the run with the largest sum, and the
pieces in it whose own words score positive are the text: an advert inside an article lies in the run,
but its words do not.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[a-zA-Z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*+(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECES = re.compile(r"[a-z]+")

#: Fixed values of the HTML standard: elements without an end tag, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select canvas audio video".split())
#: Elements whose edges end a block.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def parts(page: str) -> Iterator[tuple[str, str, frozenset[str], bool]]:
    """(tag name or '', text, features of the elements around, whether a block ends here), in page order."""
    open_: list[tuple[str, frozenset[str]]] = []
    count: Counter[str] = Counter()  # of the open elements by name: a stray end tag searches nothing
    at, lowered = 0, None
    none: frozenset[str] = frozenset()
    while m := _PART.match(page, at):
        at = m.end()
        token = m.group()
        around = open_[-1][1] if open_ else none
        if token[0] != "<" or len(token) == 1:
            yield "", token, around, False
            continue
        named = _NAME.match(token)
        if not named:
            continue  # comment, doctype, processing instruction
        name = named.group(1).lower()
        if token[1] == "/":
            if count[name]:
                last = None
                while last != name:
                    last = open_.pop()[0]
                    count[last] -= 1
            yield name, "", around, name in BLOCK
            continue
        while open_ and name in CLOSES.get(open_[-1][0], ()):
            count[open_.pop()[0]] -= 1
        own = {name, *(p for a in _ATTRIBUTE.findall(token) for p in _PIECES.findall("".join(a).lower()))} if " " in token or "\n" in token else {name}
        around = open_[-1][1] if open_ else none
        if name in BLOCK or name in RAW:  # a link or an emphasis says nothing about the text around it
            around = around | own
        yield name, "", around, name in BLOCK
        if name in RAW and not token.endswith("/>"):
            lowered = lowered or page.lower()
            # lower() may change lengths outside ASCII, so such a page is searched as it is
            end = (lowered if len(lowered) == len(page) else page).find(f"</{name}", at)
            at = len(page) if end < 0 else end
            if end < 0:
                return
            open_.append((name, around))
            count[name] += 1
        elif name not in VOID and not token.endswith("/>"):
            open_.append((name, around))
            count[name] += 1


# Labelled pages: what lies between [[ and ]] is main text, everything else is not.
LABELLED = (
    '<html><head><title>T</title></head><body><header><h1>Site name</h1><nav><ul><li><a>Home</a></li><li><a>About us</a></li></ul></nav></header><main><article>[[<h1>Title of it</h1><p>The first paragraph says a few things at length.</p><p>And a second one <b>adds</b> to them, as second ones do.</p>]]</article></main><aside class="sidebar"><h2>Related</h2><ul><li><a>Another story</a></li></ul></aside><footer><p>All rights reserved by someone</p></footer></body></html>',
    '<body><div id="nav" class="menu navigation"><a>Start</a> <a>News</a> <a>Contact</a></div><div class="ad banner">Buy this thing now, it is cheap and good.</div><div class="content post entry">[[<h1>A heading</h1><p>Some text about a matter that somebody cares for.</p><blockquote>What was said by another.</blockquote><p>Then it goes on for a while and ends.</p>]]</div><div id="comments" class="comments"><div class="comment reply"><p>First! I do not agree with any of this at all.</p></div></div><div class="footer copyright">Copyright, imprint, privacy</div></body>',
    '<body><div class="cookie consent notice popup">We use cookies to make this site better for you. <button>Accept</button></div><nav class="breadcrumb"><a>Home</a> <a>Things</a></nav><div class="article story body text">[[<h2>Title</h2><p>Words of the story come one after another here.</p><ul><li>one point made</li><li>another point made</li></ul><p>Last words of it.</p>]]<div class="share social"><a>Post this</a> <a>Mail this</a></div></div><div class="related recommended promo"><h3>More for you</h3><p>Another thing that you may like to read</p></div></body>',
    '<body><header class="header masthead"><div class="logo">Paper</div><form class="search"><label>Search for</label><input></form></header><section>[[<h1>News of the day</h1><p>In a town far away nothing happened today.</p><p>Nobody saw it and nobody told about it.</p><table><tr><td>one</td><td>two</td></tr></table>]]</section><div class="ads advert sponsored sponsor"><p>Sponsored: a product for people who need one</p></div><form class="newsletter subscribe signup"><p>Sign up and get our letter every week</p><input><button>Go</button></form><footer>Imprint</footer></body>',
    '<body><article>[[<h1>Recipe</h1><p>Take some water and heat it until it boils.</p>]]<div class="ad"><p>Pots for sale near you, very cheap.</p></div>[[<p>Then let it cool down again and drink it.</p>]]<section id="comments"><h3>Comments</h3><p>I tried it and it was fine.</p></section></article><div class="pagination pager"><a>Next page</a></div><footer><p>Imprint and terms</p></footer></body>',
    '<body><ul class="toolbar menu"><li><a>Log in</a></li><li><a>Register</a></li></ul>[[<h1>Plain page</h1><p>Everything is said in one paragraph which is rather long, as these go.</p><pre>some code</pre><p>And then there was more.</p>]]<hr><address>Mail to the author</address></body>',
    '<body><div class="alert warning banner notice">This page moved some time ago.</div><main class="main">[[<h1>Guide</h1><h2>Step one</h2><p>Open the box and take everything out of it.</p><h2>Step two</h2><ol><li>Read what is there</li><li>Do what it says</li></ol><figure><figcaption>The box as it is</figcaption></figure>]]</main><aside><p>Tips and tricks of the week for you</p></aside><div class="modal popup overlay dialog"><p>Wait, do not go yet, here is an offer</p></div><div class="tags meta byline author"><a>guide</a> <a>box</a></div></body>',
    '<body><div class="post">[[<h1>How to</h1><h3>What is needed</h3><ul><li>a pot of water</li><li>a bit of salt</li></ul><h4>How it is done</h4><p>Put one into the other and wait a little.</p><dl><dt>salt</dt><dd>what it is</dd></dl>]]</div><footer><div>Imprint</div></footer></body>',
    '<body><div class="disqus discussion replies"><p>Somebody writes what they think about it here.</p></div><nav><ol><li><a>One</a></li><li><a>Two</a></li></ol></nav><article class="article">[[<p>Only paragraphs here, without a heading of any kind.</p><p>They are short but there are <a>two links</a> in <em>this</em> one, and <a>more</a>.</p>]]</article><div class="widget sidebar"><h4>Archive</h4><ul><li>May</li><li>June</li></ul></div><div class="legal disclaimer"><p>No warranty of any kind is given.</p></div></body>',
)


def fit(pages: tuple[str, ...] = LABELLED) -> dict[str, float]:
    """Weight of every feature: smoothed log-odds of a word inside an element that has it to be main
    text, with what the page as a whole would give taken off."""
    counts = {True: Counter(), False: Counter()}
    total = Counter()
    for page in pages:
        held = page.replace("[[", "<mark-in/>").replace("]]", "<mark-out/>")
        inside = False
        for name, text, around, _ in parts(held):
            if name in ("mark-in", "mark-out"):
                inside = name == "mark-in"
                continue
            words = len(text.split())
            if words:
                total[inside] += words
                counts[inside].update(dict.fromkeys(around - {"html", "body"}, words))
    prior = math.log((total[True] + 1) / (total[False] + 1))
    features = counts[True].keys() | counts[False].keys()
    return {f: max(-4.0, min(4.0, math.log((counts[True][f] + 0.5) / (counts[False][f] + 0.5)) - prior)) for f in features}


#: What a tag costs, in words.
TAG = -0.05
#: Evidence against is none unless it is this strong: a plain list or div may hold anything.
STRONG = -1.5


def score(around: frozenset[str], weights: dict[str, float]) -> float:
    """Score of one word, between -1/2 and 1, by its best evidence for and against, against counting
    double; a stretch to leave out breaks a page only if more than half as long as what it parts."""
    known = [weights[f] for f in around if f in weights]
    for_, against = max((w for w in known if w > 0), default=0.0), min((w for w in known if w <= STRONG), default=0.0)
    value = math.tanh(0.5 + for_ / 2 + 2 * against)
    return value if value > 0 else value / 2


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text of one page: its blocks, white space as one space, joined by line ends."""
    pieces, values, cache = [], [], {}
    for name, text, around, edge in parts(page or ""):
        if name:
            pieces.append((None, edge, 0.0))
            values.append(TAG)
        else:
            own = cache.get(around)
            if own is None:
                own = cache[around] = -1.0 if not RAW.isdisjoint(around) else score(around, weights)
            pieces.append((text, False, own))
            values.append(own * len(text.split()))
    if not values:
        return ""
    sums = np.concatenate(([0.0], np.cumsum(values)))
    gain = sums - np.minimum.accumulate(sums)
    end = int(gain.argmax())
    if gain[end] <= 0:
        return ""
    start = int(sums[: end + 1].argmin())
    blocks, block = [], []
    for text, edge, own in pieces[start:end]:
        if text is not None and own > 0:
            block.append(html.unescape(text))
        elif edge or text is not None:
            blocks.append(block)
            block = []
    blocks.append(block)
    out = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in out if b)


def main_text(page: str | Column, weights: dict[str, float] | None = None) -> Column:
    weights = fit() if weights is None else weights

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(p, weights) for p in batch], dtype=object)

    return text(page)


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html); a null or empty page, or
    one without main text, has an empty text."""
    return pages.select("page_id", "url", main_text("html", weights).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
