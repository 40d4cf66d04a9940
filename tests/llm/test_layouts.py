"""Layouts in which main text is held by forms, div elements, bare text or nothing at all."""

import pytest

from orrery.llm import dom, html_main

S = [f"This is sentence number {i} of a text about rivers, hills and weather." for i in range(10)]
P = " ".join(S)
PAGES = {
    "form around": (f'<body><nav><a href=x>Home</a></nav><form id="aspnetForm"><article><p>{P}</p></article></form><footer>Imprint</footer></body>', P),
    "one div": (f"<article><div>{P}</div></article>", P),
    "four div": ("<article>" + "".join(f"<div>{P} {i}</div>" for i in range(4)) + "</article>", " ".join(f"{P} {i}" for i in range(4))),
    "two div in main": (f"<main><div>{P}</div><div>{P}</div></main>", f"{P} {P}"),
    "two bare p": (f"<p>{S[0]} {S[1]}</p><p>{S[2]} {S[3]}</p>", " ".join(S[:4])),
    "bare text": (f"<body><nav><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul></nav><article>{P}<br><br>{P}</article><footer>Imprint</footer></body>", f"{P} {P}"),
    "div after a heading": (f"<html><body><header><div class=logo>Site</div></header><div id=content><h1>Title here</h1><div>{P}</div><div>{P}</div></div><aside><h3>More</h3><ul><li><a href=q>x</a></li></ul></aside></body></html>", f"Title here {P} {P}"),
    "form beside": (f"<body><article><p>{P}</p></article><form><label>Name</label><p>Your address stays private.</p><textarea>x</textarea></form></body>", P),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layout(name):
    import numpy as np

    page, want = PAGES[name]
    nodes, segments = dom.parse(page)
    keep = html_main.decode(nodes, html_main.kept_trees().log_odds(np.array(dom.features(nodes, len(page)))).tolist())
    assert " ".join(t for i, t in segments if keep[i]) == want
