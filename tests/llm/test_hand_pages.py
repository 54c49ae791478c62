"""Pages written and labelled by hand, in the styles of common sites; none comes from the generator that trains the model.

Each entry is a page and the text blocks that belong to its article, in order.
"""

import pytest

from versoscan.llm import html

PAGES = {
    "news": (
        """<!doctype html><html><head><title>Ferry stops</title></head><body class="home single">
<a class="skip-link" href="#main">Skip to content</a>
<header class="site-header"><div class="site-logo"><a href="/">The Harbour Post</a></div>
<nav class="primary-navigation"><ul><li><a href="/local">Local</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav></header>
<main id="main"><article class="post type-post"><h1 class="entry-title">Ferry to the islands stops for a month</h1>
<div class="entry-content"><div class="wp-block-group"><p>The ferry will not sail in March.</p></div>
<p>Its engine has run for thirty years, and the <a href="/yard">yard in the north</a> has found cracks in both shafts.</p>
<h2>What travellers can do</h2><ul><li>Take the mail boat on weekdays.</li><li>Fly from the small airfield, if the wind allows it.</li></ul>
<figure class="wp-block-image"><img src="f.jpg"><figcaption>The ferry in its dock last week.</figcaption></figure>
<div class="advertisement"><p>New boots for every weather, now half price.</p></div>
<blockquote><p>We could not wait any longer, the captain said.</p></blockquote></div></article>
<section class="related-posts"><h3>More from this section</h3><ul><li><a href="/1">Mail boat gets a new mast</a></li><li><a href="/2">Airfield lights fail again</a></li></ul></section></main>
<footer class="site-footer"><p>&copy; 2023 The Harbour Post. All rights reserved.</p></footer></body></html>""",
        ["Ferry to the islands stops for a month", "The ferry will not sail in March.", "Its engine has run for thirty years, and the yard in the north has found cracks in both shafts.", "What travellers can do", "Take the mail boat on weekdays.", "Fly from the small airfield, if the wind allows it.", "The ferry in its dock last week.", "We could not wait any longer, the captain said."],
    ),
    "blog with comments": (
        """<html><body><div id="header"><h1><a href="/">Notes on bread</a></h1><p>One loaf at a time</p></div>
<div id="menu"><a href="/">Start</a> | <a href="/about">About me</a> | <a href="/feed">Feed</a></div>
<div id="content"><div class="post"><h2>Why my dough was flat</h2>
<p>For weeks my loaves came out of the oven like plates. I blamed the flour, then the oven, then the weather.</p>
<p>In the end it was the salt: I had put it straight on the yeast.</p>
<p>Mix the salt into the flour first. That is all.</p>
<div class="sharedaddy sharing"><a href="#">Mail</a> <a href="#">Print</a></div></div>
<div id="comments"><h3>2 comments</h3><ol class="commentlist"><li class="comment"><p>Thank you, this saved my Sunday.</p></li><li class="comment"><p>I never had this trouble, and I never mix anything.</p></li></ol>
<form><label>Your name</label><input><textarea></textarea><button>Send</button></form></div></div>
<div id="sidebar"><h3>Archive</h3><ul><li><a href="/may">May</a></li><li><a href="/june">June</a></li></ul><p>Subscribe to get new notes by mail.</p></div>
<div id="footer">Powered by flour and water</div></body></html>""",
        ["Why my dough was flat", "For weeks my loaves came out of the oven like plates. I blamed the flour, then the oven, then the weather.", "In the end it was the salt: I had put it straight on the yeast.", "Mix the salt into the flour first. That is all."],
    ),
    "manual": (
        """<html><body><div class="topbar"><a href="/">Docs</a><form class="search"><input placeholder="Search"></form></div>
<aside class="sidebar"><ul><li><a href="/install">Install</a></li><li><a href="/use">Use</a></li><li><a href="/faq">FAQ</a></li></ul></aside>
<main><div class="breadcrumbs"><a href="/">Docs</a> / <a href="/install">Install</a></div>
<h1>Installing the tool</h1><p>The tool needs a recent interpreter and about 40 MB of disk.</p>
<pre>tool install --user</pre><p>If this fails, see <a href="/faq">the list of known errors</a>.</p>
<table><tr><th>System</th><th>Package</th></tr><tr><td>Linux</td><td>tool-bin</td></tr></table>
<h2>Removing it</h2><p>Delete the folder. Nothing else is left behind.</p>
<nav class="pager"><a href="/">Previous</a><a href="/use">Next</a></nav></main>
<footer><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></footer></body></html>""",
        ["Installing the tool", "The tool needs a recent interpreter and about 40 MB of disk.", "tool install --user", "If this fails, see the list of known errors.", "System", "Package", "Linux", "tool-bin", "Removing it", "Delete the folder. Nothing else is left behind."],
    ),
    "plain old page": (
        """<html><body><center><a href=index.htm>home</a> - <a href=links.htm>links</a></center><hr>
<h1>The bells of our church</h1><p>There are four bells in the tower, and the oldest was cast in 1498.
<p>It cracked in the frost of 1740 and was mended with silver, as the parish book tells.
<p>The other three are younger and came by cart from the city.
<hr><address>last changed in March by the sexton</address></body></html>""",
        ["The bells of our church", "There are four bells in the tower, and the oldest was cast in 1498.", "It cracked in the frost of 1740 and was mended with silver, as the parish book tells.", "The other three are younger and came by cart from the city."],
    ),
    "encyclopedia": (
        """<html><body><div id="mw-navigation"><ul><li><a href="/">Main page</a></li><li><a href="/rand">Random article</a></li></ul></div>
<div id="content" class="mw-body"><h1 id="firstHeading">Grey heron</h1><div id="bodyContent"><div id="mw-content-text">
<p>The <b>grey heron</b> is a long-legged wading bird of the <a href="/h">heron family</a>, found in much of <a href="/e">Europe</a>.</p>
<h2>Description</h2><p>It stands up to one metre tall and weighs up to two kilograms.</p>
<p>The sexes look alike.</p><h2>Food</h2><p>It eats fish, frogs and, now and then, young birds.</p></div></div></div>
<div id="footer"><ul><li>This page was last changed on 3 May.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>""",
        ["Grey heron", "The grey heron is a long-legged wading bird of the heron family, found in much of Europe.", "Description", "It stands up to one metre tall and weighs up to two kilograms.", "The sexes look alike.", "Food", "It eats fish, frogs and, now and then, young birds."],
    ),
    "recipe": (
        """<html><body><div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div>
<nav><a href="/">Recipes</a> <a href="/tips">Tips</a></nav>
<article class="recipe"><header><h1>Lentil soup</h1><p class="subtitle">Ready in half an hour, and better the next day.</p></header>
<section class="ingredients"><h2>You need</h2><ul><li>200 g red lentils</li><li>1 onion</li><li>1 litre of stock</li></ul></section>
<section class="steps"><h2>How to do it</h2><ol><li>Fry the onion until it is soft.</li><li>Add lentils and stock, and cook for twenty minutes.</li></ol></section>
<div class="newsletter-signup"><p>Get a recipe every Friday.</p><form><input type="email"><button>Sign up</button></form></div></article>
<aside><h3>Popular</h3><ul><li><a href="/pea">Pea soup</a></li></ul></aside></body></html>""",
        ["Lentil soup", "Ready in half an hour, and better the next day.", "You need", "200 g red lentils", "1 onion", "1 litre of stock", "How to do it", "Fry the onion until it is soft.", "Add lentils and stock, and cook for twenty minutes."],
    ),
    "nested divs without names": (
        """<html><body><div><div><div><a href="/">Start</a></div><div><a href="/k">Contact</a></div></div></div>
<div><div><div><h1>Der Fluss steigt wieder</h1><div>Nach drei Tagen Regen steht das Wasser am alten Pegel wieder einen halben Meter hoch.</div>
<div>Die Feuerwehr hat die Keller am Markt leer gepumpt.</div><div>Am Freitag soll es trocken bleiben.</div></div></div></div>
<div><div><a href="/i">Impressum</a></div><div>© 2022 Stadtblatt</div></div></body></html>""",
        ["Der Fluss steigt wieder", "Nach drei Tagen Regen steht das Wasser am alten Pegel wieder einen halben Meter hoch.", "Die Feuerwehr hat die Keller am Markt leer gepumpt.", "Am Freitag soll es trocken bleiben."],
    ),
    "layout by tables": (
        """<html><body><table width=800><tr><td colspan=2><img src=logo.gif alt=""></td></tr>
<tr><td class="navigation"><a href=a.htm>History</a><br><a href=b.htm>Members</a><br><a href=c.htm>Contact</a></td>
<td><h2>The chess club in winter</h2><p>We meet on Thursdays at seven in the back room of the inn, from October to March.</p>
<p>Guests are welcome, and boards are there. In January the club plays for the silver knight.</p></td></tr>
<tr><td colspan=2 class="footer">Chess club, 12 Mill Lane</td></tr></table></body></html>""",
        ["The chess club in winter", "We meet on Thursdays at seven in the back room of the inn, from October to March.", "Guests are welcome, and boards are there. In January the club plays for the silver knight."],
    ),
    "essay about notices": (
        """<html><body><header><a href="/">Law for makers</a></header>
<main><article><h1>What a legal notice must say</h1><section class="legal"><p>A notice names who is behind a site and how to reach them.</p>
<p>It must be easy to find, and two clicks from every page are enough.</p></section>
<section id="privacy"><h2>And the privacy page</h2><p>It says which data is kept, why, and for how long.</p></section>
<p><a href="/samples">A collection of good notices from twelve countries.</a></p></article></main>
<footer><p>Law for makers, a project of the town library</p></footer></body></html>""",
        ["What a legal notice must say", "A notice names who is behind a site and how to reach them.", "It must be easy to find, and two clicks from every page are enough.", "And the privacy page", "It says which data is kept, why, and for how long.", "A collection of good notices from twelve countries."],
    ),
    "list of links": (
        """<html><body><nav><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></nav>
<div class="sidebar"><p>Our letter comes out every month.</p></div><footer>© 2021</footer></body></html>""",
        [],
    ),
}

#: Written after the composed layouts had last been changed, so that nothing was made to fit them.
LATER = {
    "forum": (
        """<html><body><div class="navbar"><a href="/">Board</a><a href="/members">Members</a></div>
<div class="content"><h1>My bicycle bell rusts</h1><div class="entry"><p>Every spring the bell is brown, although the bicycle stands in a dry shed.</p><p>Is there a kind that does not rust?</p></div></div>
<div class="replies"><div class="reply"><p>Take one of brass.</p></div><div class="reply"><p>Mine is of plastic and sounds like a frog.</p></div></div>
<div class="widget"><h4>Online now</h4><p>Three members and nine guests.</p></div><div class="footer"><p>Rules of the board</p></div></body></html>""",
        ["My bicycle bell rusts", "Every spring the bell is brown, although the bicycle stands in a dry shed.", "Is there a kind that does not rust?"],
    ),
    "magazine": (
        """<html><body><div class="masthead"><div class="tagline">Stories from the coast</div></div><nav class="menu"><ul><li><a href="/s">Stories</a></li><li><a href="/p">Pictures</a></li></ul></nav>
<div class="story"><h1>The last lamp</h1><div class="byline">By Ada Moor</div>
<div><p>On a clear night the lamp could be seen from the far shore, thirty miles away.</p></div>
<div class="pullquote"><p>Nobody told us that it would be the last evening.</p></div>
<div><p>Then a cable came, and with it a small white light that needs no keeper. The keeper packed two boxes and left.</p></div>
<div class="promo"><a href="/sub">Read four issues for the price of one</a></div>
<p>The house is still there. In summer it sells ice cream.</p></div>
<div class="recommended"><h3>You may also like</h3><p><a href="/f">The fog horn of the north pier</a></p></div>
<div class="colophon">Printed and published by the lamp keepers' union</div></body></html>""",
        ["The last lamp", "By Ada Moor", "On a clear night the lamp could be seen from the far shore, thirty miles away.", "Nobody told us that it would be the last evening.", "Then a cable came, and with it a small white light that needs no keeper. The keeper packed two boxes and left.", "The house is still there. In summer it sells ice cream."],
    ),
    "questions": (
        """<html><body><header><h2>Town office</h2></header><main><h1>Questions about bins</h1>
<dl><dt>When are the bins emptied?</dt><dd>On Mondays, and on Tuesdays after a holiday.</dd><dt>What goes into the blue one?</dt><dd>Paper. Nothing else.</dd></dl>
<p>Call us if your bin was left full.</p></main>
<div role="dialog" class="modal"><p>Would you like to answer three questions about this site?</p><button>No</button></div>
<footer><ul><li><a href="/a">Sitemap</a></li></ul><p>Town office, Market Square 1</p></footer></body></html>""",
        ["Questions about bins", "When are the bins emptied?", "On Mondays, and on Tuesdays after a holiday.", "What goes into the blue one?", "Paper. Nothing else.", "Call us if your bin was left full."],
    ),
    "release notes": (
        """<html><body><nav id="top"><a href="/">Plough</a> <a href="/docs">Docs</a> <a href="/log">Changes</a></nav>
<section class="prose"><h1>Changes in 3.2</h1><h2>New</h2><ul><li>Furrows can be <code>merged</code>.</li><li>The log has colours.</li></ul><h2>Fixed</h2><ul><li>No more crash on an empty field.</li></ul><p>Thanks to all who sent reports.</p></section>
<section class="subscribe"><h2>Stay informed</h2><p>We write twice a year.</p><form><input></form></section></body></html>""",
        ["Changes in 3.2", "New", "Furrows can be merged.", "The log has colours.", "Fixed", "No more crash on an empty field.", "Thanks to all who sent reports."],
    ),
}


def blocks_of(pages):
    """The blocks kept and those wanted, each with its page's name, and the texts."""
    texts = html.main_texts([source for source, _ in pages.values()], html.trained())
    kept = [(name, b) for name, t in zip(pages, texts, strict=True) for b in t.split("\n\n") if b]
    return kept, [(name, b) for name, (_, blocks) in pages.items() for b in blocks], texts


@pytest.mark.parametrize("pages", [PAGES, LATER])
def test_hand_labelled_pages(pages):
    """Of the blocks kept at least 95 in a hundred belong to the article, and of those that belong at least 95 are kept."""
    kept, wanted, texts = blocks_of(pages)
    both = len(set(kept) & set(wanted))
    assert len(set(wanted)) == len(wanted)
    assert both / len(kept) >= 0.95 and both / len(wanted) >= 0.95, (sorted(set(kept) - set(wanted)), sorted(set(wanted) - set(kept)))
    for text, (_, blocks) in zip(texts, pages.values(), strict=True):  # what is kept stays in page order
        order = [blocks.index(b) for b in text.split("\n\n") if b in blocks]
        assert order == sorted(order)


def test_linked_paragraphs_stay():
    sentence = "The council met on Tuesday to decide what the town should do"
    nav = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    for wrap in ("<p><a href=/x>{}.</a></p>", "<p>Read: <a href=/x>{}</a> today.</p>"):
        page = f"{nav}<article><h1>A title</h1><p>The mill stood by the river. Nobody knows who built it.</p>{wrap.format(sentence)}<p>People came from far away to see it turn.</p></article>"
        assert sentence in html.main_texts([page], html.trained())[0]
    listed = f"{nav}<article><h1>A title</h1><p>The mill stood by the river. Nobody knows who built it.</p></article><aside class=related><h3>Related</h3><ul><li><a href=/x>{sentence}</a></li></ul></aside>"
    assert sentence not in html.main_texts([listed], html.trained())[0]


def test_very_long_pages_and_empty_tables(spark):
    one = "One of the many sentences that this page holds."
    text = html.main_texts([f"<article>{f'<p>{one}</p>' * 60_000}</article><footer>© x</footer>"], html.trained())[0]
    assert text.split("\n\n") == [one] * 60_000
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).collect() == [] and html.extract(empty).columns == ["page_id", "url", "text", "n_chars"]
