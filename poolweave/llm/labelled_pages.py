"""Labelled pages that the weights of main text extraction are learnt from.

In the templates M and a number stand for so many words of the article, O for words of anything
else. Each is filled several times, with texts of other lengths.
"""

from __future__ import annotations

import re

#: Page templates.
TEMPLATES = """
<html><head><title>O4</title><script>O6</script></head><body><nav><ul><li><a href=/>O1</a><li><a href=/>O1</a><li><a href=/>O2</a></ul></nav><article><h1>M6</h1><p>M40</p><p>M2</p><p>M60</p></article><footer>O12</footer></body></html>
<!doctype html><html><body><div class="header"><a href=/>O2</a> O6</div><div class="ad">O14</div><article><h1>M9</h1><p><b>M7<br><p>M30</p><p>M1</p></article><footer>&copy; O14</footer>
<html><body><header><h1>O3</h1><p>O8</p><nav><a href=1>O1</a> <a href=2>O1</a> <a href=3>O1</a></nav></header><main><h1>M5</h1><p>M50</p><h2>M3</h2><p>M80</p><ul><li>M6</li><li>M9</li><li>M4</li></ul></main><aside><h3>O2</h3><ul><li><a href=4>O5</a></li><li><a href=5>O6</a></li></ul></aside><footer><p>O20</p></footer></body></html>
<body><div id="cookie-notice"><p>O30</p><button>O1</button></div><div id="menu"><a href=a>O2</a><a href=b>O2</a></div><div id="content"><h2>M4</h2><p>M25</p><div class="advert"><p>O10</p></div><p>M35</p><blockquote>M12</blockquote><p>M3</p></div><div id="footer">O9</div></body>
<html><body><table><tr><td colspan=2><a href=1>O2</a> | <a href=2>O2</a> | <a href=3>O1</a></td></tr><tr><td><a href=4>O2</a><br><a href=5>O3</a><br><a href=6>O2</a></td><td><h1>M5</h1><p>M60</p><p>M45</p></td></tr><tr><td>O5</td></tr></table></body></html>
<body><div><a href=1>O1</a> <a href=2>O2</a> <a href=3>O1</a> <a href=4>O1</a></div><div><div><h1>M6</h1><div>M45</div><div>M70</div><div>M20</div></div></div><div><a href=5>O2</a> <a href=6>O2</a></div><div>O4</div></body>
<body><header role="banner"><div class="logo">O2</div></header><section class="post"><header><h1>M7</h1><p>M4</p></header><p>M33</p><figure><img src=x><figcaption>M6</figcaption></figure><p>M41</p><footer>O8</footer></section><section id="comments"><h3>O2</h3><div class="comment"><p>O30</p></div><div class="comment"><p>O55</p></div></section></body>
<body><nav><a href=1>O1</a></nav><article><h1>M4</h1><p>M4</p></article><section class="comments"><article class="comment"><p>O40</p></article><article class="comment"><p>O60</p></article></section><footer><p>O25</p></footer></body>
<body><div class="banner">O18</div><div class="main-content"><h1>M8</h1><p>M20 <a href=1>M3</a> M12</p><form action=/s><label>O2</label><input name=q><p>O10</p></form><p>M22 <em>M2</em> M9</p><p>M1</p></div><div class="sidebar"><p>O35</p><p>O15</p></div></body>
<body><form id="aspnetForm"><div id="topnav"><a href=1>O1</a><a href=2>O1</a></div><article><h1>M5</h1><p>M30</p><p>M28</p></article><div id="footer"><p>O16</p></div></form></body>
<body><ul class="breadcrumb"><li><a href=1>O1</a></li><li><a href=2>O1</a></li></ul><div class="entry-content"><p>M18</p><p>M27</p><table><tr><th>M1</th><th>M1</th></tr><tr><td>M2</td><td>M1</td></tr></table><p>M14</p></div><div class="share-buttons"><a href=3>O1</a><a href=4>O1</a></div><div class="related"><h4>O2</h4><a href=5>O7</a><a href=6>O8</a></div></body>
<body><p><a href=1>O2</a> <a href=2>O2</a></p><h1>M7</h1><p>M55</p><p>M35</p><p>M5</p><hr><p><a href=3>O3</a> <a href=4>O1</a></p></body>
<body><div role="navigation"><ul><li><a href=1>O2</a></li><li><a href=2>O1</a></li><li><a href=3>O1</a></li><li><a href=4>O2</a></li></ul></div><div role="main"><h1>M5</h1><p>M3</p><ol><li>M10</li><li>M14</li></ol><pre>M20</pre></div><div role="contentinfo">O22</div></body>
<body><div class="notice"><p>O24</p><p>O12</p></div><article><header><h1>M6</h1></header><p>M60</p><aside><p>O15</p></aside><p>M45</p><div class="newsletter"><form><p>O12</p></form></div><p>M8</p></article></body>
<body><nav><ul><li><a href=1>O2</a></li><li><a href=2>O2</a></li></ul></nav><article><p>M3</p></article><div class="widget"><p>O28</p></div><footer>O30</footer></body>
<body><div class="nav"><a href=1>O1</a></div><div class="story"><h1>M6</h1><h2>M9</h2><p>M44</p><ul><li><a href=2>M2</a></li><li><a href=3>M3</a></li><li><a href=4>M2</a></li></ul><p>M30</p></div><div class="promo"><p>O19</p></div><div class="footer"><p>O11</p></div></body>
<body><div id="page"><div id="masthead">O4</div><div id="content-sidebar-wrap"><div id="main"><h1>M5</h1><p>M38</p><p>M2</p></div><div id="sidebar"><p>O26</p></div></div></div></body>
<body><div class="top">O6</div><div class="text"><p>M33</p><p>M29</p><p>M41</p></div><div class="bottom"><a href=1>O2</a><a href=2>O2</a><a href=3>O1</a></div></body>
<body><div><a href=1>O1</a> <a href=2>O1</a> <a href=3>O1</a></div><div><h1>M2</h1><p>M24</p><p>M16</p></div><div><a href=4>O1</a> <a href=5>O1</a> <a href=6>O2</a></div></body>
<body><p>O3</p><ul><li><a href=1>O1</a></li><li><a href=2>O1</a></li></ul><h1>M1</h1><h3>M4</h3><p>M50</p><p>M4</p><p>M21</p><ul><li><a href=3>O2</a></li><li><a href=4>O1</a></li></ul></body>
<body><div id="head">O5</div><div class="post-content"><h1>M4</h1><p>M30</p><div class="ad"><p>O9</p></div><p>M1</p></div><div class="footer"><p>O9</p></div></body>
<body><nav><a href=1>O1</a></nav><article><h1>M3</h1><p>M20</p><form><p>O6</p><label>O1</label></form><aside><ul><li><a href=2>O3</a></li><li><a href=3>O2</a></li></ul></aside><p>M1</p></article><div class="comments"><p>O12</p><p>O20</p></div></body>
<body><ul class=menu><li><a href=1>O1</a></li><li><a href=2>O2</a></li></ul><article><h1>M1</h1><p><i>M1</i><br><p>M30</p><p>M1</p><p>M2</p></article><footer>O8</footer></body>
""".strip().split("\n")  # fmt: skip
#: How long the texts are in each copy of a template.
SCALES = (1.0, 0.4, 3.0)


def _words(kind: str, count: int, at: int) -> str:
    start, ends = ("ma", "rilonetu") if kind == "M" else ("ov", "kidasemo")
    return " ".join(start + ends[2 * (i % 4) : 2 * (i % 4) + 2] * (1 + (at + i) % 3) + str((at + 7 * i) % 10) for i in range(count))


def labelled() -> list[tuple[str, set[str]]]:
    """(html, words of its article) for each filled template."""
    out = []
    for scale in SCALES:
        for at, template in enumerate(TEMPLATES):
            main: set[str] = set()

            def filled(found: re.Match, at: int = at, main: set[str] = main) -> str:
                count = int(found[2])
                text = _words(found[1], count if count < 5 else max(4, round(count * scale)), at + found.start())
                if found[1] == "M":
                    main.update(text.split())
                return text

            out.append((re.sub(r"\b([MO])(\d+)\b", filled, template), main))
    return out
