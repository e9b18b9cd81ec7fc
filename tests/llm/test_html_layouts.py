"""Hand-written layouts, none of them of the composer's, and what of them is main text."""

import pytest

from mensura.llm import common, html_extraction

P = "The river rises in the north and runs for many miles through the hills before it meets the sea."
Q = "Its valley was settled early, and most of the towns along it still live from the trade on the water."
C = "I went there last year and liked it a lot, thank you for the article."
D = "We have never been, but my uncle worked on one of the boats for years."

LAYOUTS = {
    "german comments": (f"<main><h1>Fluss</h1><p>{P}</p><p>{Q}</p></main><div class='kommentare'><p>{C}</p><p>{D}</p></div>", ["Fluss", P, Q]),
    "french comments": (f"<article><h1>Eau</h1><p>{P}</p></article><section id='commentaires'><div>{C}</div><div>{D}</div></section>", ["Eau", P]),
    "spanish comments": (f"<div class='contenido'><h1>Agua</h1><p>{P}</p><p>{Q}</p><div class='comentarios'><p>{C}</p></div></div>", ["Agua", P, Q]),
    "comments by structure": (f"<article><h1>River</h1><p>{P}</p><p>{Q}</p></article><h3>2 replies</h3><ul><li><h4>Ann</h4><p>{C}</p></li><li><h4>Bob</h4><p>{D}</p></li></ul>", ["River", P, Q]),
    "comment rows": (f"<div class='post'><h2>River</h2><p>{P}</p></div><div><div><p><b>Ann</b> 3 May</p><p>{C}</p></div><div><p><b>Bob</b> 4 May</p><p>{D}</p></div></div>", ["River", P]),
    "table columns": (f"<table><tr><td><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>About us</a></td><td><h1>River</h1><p>{P}</p><p>{Q}</p></td></tr></table>", ["River", P, Q]),
    "pager": (f"<article><h1>River</h1><p>{P}</p><p>{Q}</p><p><a href=/>Home</a> | <a href=/2>Next</a></p></article>", ["River", P, Q]),
    "pager below": (f"<div id=main><h1>River</h1><p>{P}</p><p>{Q}</p></div><div><a href=/1>Previous</a> <a href=/2>Next</a></div>", ["River", P, Q]),
    "options": (f"<article><h1>River</h1><p>{P}</p><select><option>Metres<option>Feet</select><p>{Q}</p></article>", ["River", P, Q]),
    "button": (f"<main><p>{P}</p><button>Show more</button><p>{Q}</p></main>", [P, Q]),
    "one form": (f"<form><div id=content><h1>River</h1><p>{P}</p><p>{Q}</p></div></form>", ["River", P, Q]),
    "german frame": (f"<div class='kopfzeile'>Die Zeitung</div><ul class='hauptmenue'><li><a href=/>Start</a><li><a href=/p>Politik</a></ul><div class='beitrag'><h1>Fluss</h1><p>{P}</p><p>{Q}</p></div><div class='werbung'>Jetzt kaufen und sparen</div><div class='fusszeile'>Impressum</div>", ["Fluss", P, Q]),
    "french frame": (f"<div class='publicite'>Achetez maintenant</div><div class='contenu'><h1>Eau</h1><p>{P}</p></div><div class='pied'>Mentions</div>", ["Eau", P]),
    "spanish frame": (f"<nav><a href=/>Inicio</a></nav><main><h1>Agua</h1><p>{P}</p><p>{Q}</p></main><div class='publicidad'>Compre ya</div><div class='aviso'>Usamos galletas</div>", ["Agua", P, Q]),
    "trail": (f"<p><a href=/>Home</a> &raquo; <a href=/r>Rivers</a> &raquo; <a href=/n>North</a></p><article><h1>River</h1><p>{P}</p></article>", ["River", P]),
    "list in text": (f"<article><h1>River</h1><p>{P}</p><ul><li>Low water in summer</li><li>High water in spring</li></ul><p>{Q}</p></article>", ["River", P, "Low water in summer", "High water in spring", Q]),
    "table in text": (f"<article><h1>River</h1><p>{P}</p><table><tr><td>Length</td><td>300 miles</td></tr><tr><td>Towns</td><td>12</td></tr></table><p>{Q}</p></article>", ["River", P, "Length", "300 miles", "Towns", "12", Q]),
    "quotation": (f"<main><h1>River</h1><p>{P}</p><blockquote><p>{Q}</p></blockquote></main>", ["River", P, Q]),
    "linked word": (f"<main><h1>River</h1><p>{P} See <a href=/s>the sea</a>.</p><p>{Q}</p></main>", ["River", f"{P} See the sea.", Q]),
    "related": (f"<article><h1>River</h1><p>{P}</p><p>{Q}</p></article><aside><h3>More</h3><ul><li><a href=/1>The lake</a></li><li><a href=/2>The sea</a></li></ul></aside><footer>All rights reserved</footer>", ["River", P, Q]),
}
#: Layouts that are still misjudged; the README counts them.
MISJUDGED: set[str] = set()


@pytest.fixture(scope="module")
def model(spark):
    return html_extraction.train(common.table(spark, "/root/testdata/sf0.01", "pages"))


@pytest.mark.parametrize("name", LAYOUTS)
def test_hand_written_layout(model, name):
    markup, texts = LAYOUTS[name]
    page = html_extraction.read_page(f"<!DOCTYPE html><html><head><title>River</title></head><body>{markup}</body></html>")
    got = html_extraction.decode(page, model.probability([page])[0])
    assert (got == texts) == (name not in MISJUDGED), got
