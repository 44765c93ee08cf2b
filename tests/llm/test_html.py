"""Main text of pages whose article is known because the page was built round it, in four scripts; and time on hostile pages."""

import html
import random
import time

import pytest

from grainflow.llm.extract import main_text

WORDS = {
    "latin": ("the river carried old boats past quiet towns where people waited for news of summer rain".split(), " ", ", ", "."),
    "han": (list("河水流过安静的小城人们等待夏天雨季消息老船慢行远方山谷书店灯光"), "", "，", "。"),
    "arabic": ("النهر يحمل القوارب القديمة نحو المدن الهادئة حيث ينتظر الناس أخبار المطر".split(), " ", "، ", "."),
    "devanagari": ("नदी पुरानी नावों को शांत शहरों के पास ले जाती है जहाँ लोग बारिश की खबर की प्रतीक्षा करते हैं".split(), " ", ", ", "।"),
}
JUNK = [
    '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>',
    "<div>menu, a, b, c, d, e, f, g</div>",
    '<div class="ad-box">Buy, buy, buy now. It is cheap, fast, good.</div>',
    '<div id="cookieNotice"><p>We use cookies, of course, and so on.</p></div>',
    '<aside><p>See, also, this long remark on other things, please.</p></aside>',
    "<form><p>Your name, please</p><input name=q><button>Go</button></form>",
    '<div role="complementary"><p>Side, side, side.</p></div>',
    '<div style="display: none"><p>Hidden, but long, text.</p></div>',
    '<script>var x = "<p>not text, at all</p>";</script><style>p { color: red }</style><!-- <p>no</p> -->',
]
INSIDE = [
    '<span class="advert">BUY NOW</span>',
    "<span hidden>not shown</span>",
    '<button>Share</button>',
    "<script>track()</script>",
    '<div class="share-buttons"><a href=x>Post</a> <a href=y>Send</a></div>',
    '<div id="comments"><p>I read this, and I disagree, strongly.</p></div>',
    '<article class="comment"><p>Me too, as it happens, friend.</p></article>',
    "<footer>Filed under news, by someone</footer>",
    "<figure hidden><p>x</p></figure>",
]


def sentence(rng, script):
    words, gap, comma, stop = WORDS[script]
    return comma.join(gap.join(rng.choice(words) for _ in range(rng.randint(4, 9))) for _ in range(rng.randint(1, 4))) + stop


def build(seed):
    rng = random.Random(seed)
    script = rng.choice(list(WORDS))
    blocks = [" ".join(sentence(rng, script) for _ in range(rng.randint(4, 8))) for _ in range(rng.randint(3, 7))]
    body = []
    for b in blocks:
        text = html.escape(b, quote=False).replace(" ", rng.choice([" ", "\n  ", " \t"]), 1)
        at = text.find(" ")
        if at > 0 and rng.random() < 0.5:
            text = f"{text[:at]} <b>{text[at + 1:]}</b>"
        body.append(f"<p>{text}{rng.choice(['</p>', ''])}")
        if rng.random() < 0.5:
            body.append(rng.choice(INSIDE[4:]))
        elif rng.random() < 0.3:
            body[-1] = f"<p>{text} {rng.choice(INSIDE[:4])}</p>"
    open_, close = rng.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ("<div class=story>", "</div>"), ('<div id="content"><section>', "</section></div>")])
    before, after = (rng.sample(JUNK, rng.randint(0, 4)) for _ in range(2))
    page = f"<!DOCTYPE html><html><head><title>x, y</title></head><body class='has-sidebar'>{''.join(before)}{open_}{''.join(body)}{close}{''.join(after)}<footer>(c)</footer></body></html>"
    return page, "\n\n".join(blocks)


@pytest.mark.parametrize("seed", range(120))
def test_the_article_and_nothing_else(seed):
    page, text = build(seed)
    assert main_text(page) == text


def test_single_cases():
    cjk = "这是一个很长的段落，用来测试正文；它没有别的逗号。" * 14
    assert main_text(f"<div>menu, a, b, c, d, e, f, g</div><div><p>{cjk}</p></div>") == cjk
    assert main_text('<p>One, <span class="advert">BUY NOW</span> two <span hidden>no <span>x</span> no</span>three.</p>') == "One, two three."
    assert main_text('<main><p>The text, of some length.</p><article class="comment"><p>No, it is not.</p></article></main>') == "The text, of some length."
    assert main_text('<div class="shared-notice"><p>The only text, here.</p></div>') == "The only text, here."
    assert main_text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be given.</p>") == "Let x=2 be given."
    assert main_text("<pre>code <span class=hljs-comment># kept</span></pre>") == "code # kept"
    assert main_text("<p>super<wbr>market<p>a<hr>b") == "supermarket\n\na\n\nb"
    assert main_text("<ul><li>one, two<li>three<ul><li>four</ul><li>five</ul>") == "one, two\n\nthree\n\nfour\n\nfive"


HOSTILE = {
    "stray closing tags": "<div>" * 8000 + "</section></b>" * 8000 + "x",
    "open quotes": '<a "' * 8000 + ">x",
    "open values": '<a b="' * 8000 + ">x",
    "no end": "<a " * 20_000,
    "pairs of quotes": '<a b="1" ' * 8000 + "'>\" x",
    "items": "<ul><li><ul>" + "<div>" * 8000 + "<li></li>" * 8000 + "x",
    "cells": "<table><tr>" + "<td>" * 20_000 + "x",
    "paragraphs": "<p>x" * 30_000,
    "inline junk": "<span class=ad>" * 30_000 + "x",
    "comments": "<!--" * 50_000,
    "signs": "<" * 200_000,
    "scripts": "<script>" * 30_000,
    "named": "<div class=menu>" * 8000 + "x",
    "attributes": "<div " + "a='b' " * 30_000 + ">x</div>",
    "text": "word, " * 300_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_linear(name):
    began = time.thread_time()
    main_text(HOSTILE[name])
    assert time.thread_time() - began < 3


LONG = "A long paragraph, with commas, and words, that goes on for a while, so that it scores well enough. " * 6
SHAPES = {
    "sections alike": (f"<div class=content><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Short.</p></section></div>", ["One", LONG, "Two", "Short."]),
    "a short part at the end": (f"<div><div><p>{LONG}</p></div><div><p>Brief closing words</p></div></div>", [LONG, "Brief closing words"]),
    "title and byline beside the text": (f"<body><h1>Head</h1><p class=byline>By Ann, today</p><div class=body><p>{LONG}</p></div></body>", ["Head", "By Ann, today", LONG]),
    "a menu in an article": (f"<article><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul><p>{LONG}</p></article>", [LONG]),
    "sources are no menu": (f"<article><p>{LONG}</p><ul>" + "".join(f"<li><a href=/{i}>A study of many things that was published in the year {i}</a></li>" for i in (1, 2)) + "</ul></article>", [LONG, *(f"A study of many things that was published in the year {i}" for i in (1, 2))]),
    "related posts": (f"<article><p>{LONG}</p><div class=related-posts>" + f"<p>{LONG}</p>" * 6 + "</div></article>", [LONG]),
    "nothing but related posts": (f"<div class=related-posts><p>{LONG}</p></div>", [LONG]),
    "comments by a longer word": (f"<article><p>{LONG}</p><div class=usercomments><p>{LONG}</p></div></article>", [LONG]),
    "a commentary is a text": (f"<article class=commentary><p>{LONG}</p></article>", [LONG]),
    "a thread under a text": (f"<article><p>{LONG}</p><div class=discussion-thread><p>{LONG}</p><p>{LONG}</p></div></article>", [LONG]),
    "entries that look alike": (f"<article><p>{LONG}</p><div>" + f"<div class=e><div class=avatar>x</div><p>{LONG}</p></div>" * 3 + "</div></article>", [LONG]),
    "parts that look alike": (f"<article><div class=e><p>{LONG}</p></div><div class=e><p>Two, in short.</p></div></article>", [LONG, "Two, in short."]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(shape):
    page, want = SHAPES[shape]
    assert main_text(page) == "\n\n".join(x.strip() for x in want)
