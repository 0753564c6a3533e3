"""A small fixed set of pages and what the page stage gives for them: every kind of block, menu, link and content strategy.

Whole-table queries of the page stage run over test markup that has no structural blocks and no language switchers, and
SQL cannot parse pages. These queries parse the pages below; their SQL lists fixed rows, which were taken from this
library's output and read over against the markup. They guard against change; they are no second implementation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import backfill
from ..operators.pages import parse_pages
from ..runtime import ship_package

PAGES = [
    (1, "https://shop.example/guide/paint", """<html lang="en-GB"><head><title> Choosing paint </title><meta name="description" content=" How to choose paint "><meta property="og:image" content="/img/paint.png"><link rel="canonical" href="/guide/paint"></head><body>
<header><nav><ul><li><a href="/">Home</a></li><li><a href="/guide/">Guides</a><ul class="sub-menu"><li><a href="/guide/paint">Paint</a></li><li><a href="https://other.example/tools">Tools</a></li></ul></li><li><a href="/contact">Contact</a></li></ul></nav><a href="tel:5550100">Call us</a></header>
<nav class="breadcrumb"><a href="/">Home</a> <a href="/guide/">Guides</a> <span>Paint</span></nav>
<main><article><h1>Choosing <em>paint</em></h1>
<ul class="toc"><li><a href="#walls">Walls</a></li><li><a href="#doors">Doors</a></li></ul>
<h2 id="walls">Walls</h2><p>Matt paint hides what plaster shows, and <a href="/guide/primer">a primer</a> saves a coat. Roll it on from the window inwards, one wall after the other, and keep a wet edge so that no seams remain where the strokes meet.</p>
<h2 id="doors">Doors</h2><p>Gloss paint wipes clean. Sand the old coat lightly, dust it off and lay the door flat if you can, because a flat door lets the paint level out. Two thin coats are better than a thick one, and a night between them is better than an hour.</p>
<div class="faq" itemtype="https://schema.org/FAQPage"><div class="faq-question">How long does it dry?</div><div class="faq-answer">Four hours, see <a href="/guide/drying">drying</a>.</div><div class="question"><button>Can I paint in winter?</button></div><p>Above ten degrees.</p></div>
<div class="call-to-action"><form action="/order"><button> Order samples </button></form></div>
<div class="accordion"><p>Tools you need: a roller, a tray and tape.</p></div>
<div class="testimonial"><p>The best paint I ever used.</p></div>
<div class="author-bio"><p>Ida has painted for thirty years.</p></div>
<div class="related-posts"><a href="/guide/wallpaper">Wallpaper</a></div>
</article></main>
<footer><ul><li><a href="/imprint">Imprint</a></li><li><a href="https://facebook.com/shop">Facebook</a></li></ul></footer></body></html>"""),
    (2, "http://blog.example/p/2?x=1", """<html><head><meta property="og:title" content="From the graph"><meta property="og:description" content="Graph text"><meta http-equiv="content-language" content="fr"><script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Why?"},{"@type":"Question","name":"How?"}]}</script></head><body><h1>First</h1><h1> </h1><h3>Third level</h3><div class="lang-switcher"><a href="/en" hreflang="en">English</a><a href="/fr" hreflang="fr">Français</a></div><p>Short <b>text</b> only.</p></body></html>"""),
    (5, "https://cms.example/a/b", """<html><body><div class="sidebar"><p>Aside</p></div><div class="post-content">""" + "<p>One plain sentence of the post.</p>" * 20 + """<p><img src="/i.png" alt="A door"> <code>x</code></p><pre><code class="language-sh">ls -l
</code></pre><ol><li>first</li><li>second<ul><li>inner</li></ul></li></ol><blockquote><p>Said so.</p></blockquote><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><script>no()</script></div></body></html>"""),
    (6, "https://own.example/x", "<body><div class='top'>Top line</div><div class='box'>" + "Loose words without a paragraph around them. " * 16 + "<span class='ad2'>Buy now</span></div></body>"),
    (3, "https://plain.example/", "<p>No head at all, <a href='mailto:a@plain.example'>mail</a> <a href='//cdn.example/x'>file</a>"),
    (4, "https://empty.example/", ""),
]

EXPECTED = {
    "metadata": [
        (1, 'Choosing paint', 'Choosing paint', 'How to choose paint', 'https://shop.example/guide/paint', 'https://shop.example/img/paint.png', 'en-GB', 1),
        (2, 'From the graph', 'First', 'Graph text', None, None, 'fr', 2),
        (5, None, None, None, None, None, None, 0),
        (6, None, None, None, None, None, None, 0),
        (3, None, None, None, None, None, None, 0),
    ],
    "headings": [
        (1, 0, 1, 'Choosing paint', 0),
        (1, 1, 2, 'Walls', 1),
        (1, 2, 2, 'Doors', 2),
        (2, 0, 1, 'First', 0),
        (2, 1, 3, 'Third level', 1),
    ],
    "elements": [
        (1, 0, 'faq_module', 1281, 1568, '[itemtype*="FAQPage"]', 1, True, 'Can I paint in winter?', None, None, None, None, None, None),
        (1, 1, 'faq_module', 1336, 1389, '[class*="faq"]', 0, False, '', None, None, None, None, None, None),
        (1, 2, 'faq_module', 1389, 1470, '[class*="faq"]', 0, False, '', None, None, None, None, None, None),
        (1, 3, 'toc_or_jump', 666, 757, '.toc', None, None, None, 2, 2, True, None, None, None),
        (1, 4, 'breadcrumb', 519, 617, '.breadcrumb', None, None, None, None, None, None, None, None, None),
        (1, 5, 'template_cta', 1569, 1664, '.call-to-action', None, None, None, None, None, None, True, True, 'Order samples'),
        (1, 6, 'accordion', 1665, 1743, '.accordion', None, None, None, None, None, None, None, None, None),
        (1, 7, 'testimonial', 1744, 1809, '.testimonial', None, None, None, None, None, None, None, None, None),
        (1, 8, 'author_bio', 1810, 1880, '.author-bio', None, None, None, None, None, None, None, None, None),
        (1, 9, 'related_posts', 1881, 1954, '.related-posts', None, None, None, None, None, None, None, None, None),
        (2, 0, 'faq_module', 165, 313, None, 2, True, 'Why?|How?', None, None, None, None, None, None),
    ],
    "stats": [
        (1, 3, 1, 0, 1, 1, 1, 1, 1),
        (2, 0, 0, 0, 0, 0, 0, 0, 0),
        (5, 0, 0, 0, 0, 0, 0, 0, 0),
        (6, 0, 0, 0, 0, 0, 0, 0, 0),
        (3, 0, 0, 0, 0, 0, 0, 0, 0),
    ],
    "content": [
        (1, 'readability', 127, 0.0483, '<article><h1>Choosing <em>paint</em></h1>\n<ul class="toc"><li><a href="#walls">Walls</a></li><li><a href="#doors">Doors</a></li></ul>\n<h2 id="walls">Walls</h2><p>Matt paint hides what plaster shows, and <a href="/guide/primer">a primer</a> saves a coat. Roll it on from the window inwards, one wall after the other, and keep a wet edge so that no seams remain where the strokes meet.</p>\n<h2 id="doors">Doors</h2><p>Gloss paint wipes clean. Sand the old coat lightly, dust it off and lay the door flat if you can, because a flat door lets the paint level out. Two thin coats are better than a thick one, and a night between them is better than an hour.</p>\n<div class="faq" itemtype="https://schema.org/FAQPage"><div class="faq-question">How long does it dry?</div><div class="faq-answer">Four hours, see <a href="/guide/drying">drying</a>.</div><div class="question"><button>Can I paint in winter?</button></div><p>Above ten degrees.</p></div>\n<div class="call-to-action"><form action="/order"><button> Order samples </button></form></div>\n<div class="accordion"><p>Tools you need: a roller, a tray and tape.</p></div>\n<div class="testimonial"><p>The best paint I ever used.</p></div>\n<div class="author-bio"><p>Ida has painted for thirty years.</p></div>\n<div class="related-posts"><a href="/guide/wallpaper">Wallpaper</a></div>\n</article>'),
        (2, 'fallback', 5, 0.3125, '<h1>First</h1><h1> </h1><h3>Third level</h3><div class="lang-switcher"><a href="/en" hreflang="en">English</a><a href="/fr" hreflang="fr">Français</a></div><p>Short <b>text</b> only.</p>'),
        (5, 'readability', 105, 0.0, '<div class="post-content"><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p>One plain sentence of the post.</p><p><img src="/i.png" alt="A door"> <code>x</code></p><pre><code class="language-sh">ls -l\n</code></pre><ol><li>first</li><li>second<ul><li>inner</li></ul></li></ol><blockquote><p>Said so.</p></blockquote><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></div>'),
        (6, 'fallback', 115, 0.0, '<div class="top">Top line</div><div class="box">Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. <span class="ad2">Buy now</span></div>'),
        (3, 'fallback', 6, 0.32, '<p>No head at all, <a href="mailto:a@plain.example">mail</a> <a href="//cdn.example/x">file</a></p>'),
        (4, 'fallback', 0, 1.0, ''),
    ],
    "markdown": [
        (1, '# Choosing paint\n\n# Choosing *paint*\n\n-   [Walls](https://shop.example/guide/paint#walls)\n-   [Doors](https://shop.example/guide/paint#doors)\n\n## Walls\n\nMatt paint hides what plaster shows, and [a primer](https://shop.example/guide/primer) saves a coat. Roll it on from the window inwards, one wall after the other, and keep a wet edge so that no seams remain where the strokes meet.\n\n## Doors\n\nGloss paint wipes clean. Sand the old coat lightly, dust it off and lay the door flat if you can, because a flat door lets the paint level out. Two thin coats are better than a thick one, and a night between them is better than an hour.\n\nHow long does it dry?\n\nFour hours, see [drying](https://shop.example/guide/drying).\n\nCan I paint in winter?\n\nAbove ten degrees.\n\nOrder samples\n\nTools you need: a roller, a tray and tape.\n\nThe best paint I ever used.\n\nIda has painted for thirty years.\n\n[Wallpaper](https://shop.example/guide/wallpaper)', '# Choosing paint\n\n# Choosing *paint*\n\n<!-- STRUCT:TOC:START -->\n-   [Walls](https://shop.example/guide/paint#walls)\n-   [Doors](https://shop.example/guide/paint#doors)\n<!-- STRUCT:TOC:END -->\n\n## Walls\n\nMatt paint hides what plaster shows, and [a primer](https://shop.example/guide/primer) saves a coat. Roll it on from the window inwards, one wall after the other, and keep a wet edge so that no seams remain where the strokes meet.\n\n## Doors\n\nGloss paint wipes clean. Sand the old coat lightly, dust it off and lay the door flat if you can, because a flat door lets the paint level out. Two thin coats are better than a thick one, and a night between them is better than an hour.\n\n<!-- STRUCT:FAQ:START -->\n<!-- STRUCT:FAQ:START -->\n<!-- STRUCT:FAQ:Q -->How long does it dry?\n<!-- STRUCT:FAQ:END -->\n\n<!-- STRUCT:FAQ:START -->\n<!-- STRUCT:FAQ:A -->Four hours, see [drying](https://shop.example/guide/drying).\n<!-- STRUCT:FAQ:END -->\n\n<!-- STRUCT:FAQ:Q -->Can I paint in winter?\n\nAbove ten degrees.\n<!-- STRUCT:FAQ:END -->\n\n<!-- STRUCT:CTA:START -->\nOrder samples\n<!-- STRUCT:CTA:END -->\n\n<!-- STRUCT:ACCORDION:START -->\nTools you need: a roller, a tray and tape.\n<!-- STRUCT:ACCORDION:END -->\n\n<!-- STRUCT:TESTIMONIAL:START -->\nThe best paint I ever used.\n<!-- STRUCT:TESTIMONIAL:END -->\n\n<!-- STRUCT:AUTHOR:START -->\nIda has painted for thirty years.\n<!-- STRUCT:AUTHOR:END -->\n\n<!-- STRUCT:RELATED:START -->\n[Wallpaper](https://shop.example/guide/wallpaper)\n<!-- STRUCT:RELATED:END -->'),
        (2, '# First\n\n# First\n\n### Third level\n\n[English](http://blog.example/en)[Français](http://blog.example/fr)\n\nShort **text** only.', '# First\n\n# First\n\n### Third level\n\n[English](http://blog.example/en)[Français](http://blog.example/fr)\n\nShort **text** only.'),
        (5, 'One plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\n![A door](https://cms.example/i.png) `x`\n\n```sh\nls -l\n```\n\n1.  first\n2.  second\n    -   inner\n\n> Said so.\n\na\n\nb\n\n1\n\n2', 'One plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\n![A door](https://cms.example/i.png) `x`\n\n```sh\nls -l\n```\n\n1.  first\n2.  second\n    -   inner\n\n> Said so.\n\na\n\nb\n\n1\n\n2'),
        (6, 'Top line\n\nLoose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Buy now', 'Top line\n\nLoose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Buy now'),
        (3, 'No head at all, [mail](mailto:a@plain.example) [file](https://cdn.example/x)', 'No head at all, [mail](mailto:a@plain.example) [file](https://cdn.example/x)'),
    ],
    "menus": [
        (1, 'primary_nav', 0, 'https://shop.example/', 'Home', 0, 0, None, False, 'text'),
        (1, 'primary_nav', 1, 'https://shop.example/guide', 'Guides', 0, 1, None, False, 'text'),
        (1, 'primary_nav', 2, 'https://shop.example/guide/paint', 'Paint', 1, 0, 'Guides', False, 'text'),
        (1, 'primary_nav', 3, 'https://other.example/tools', 'Tools', 1, 1, 'Guides', True, 'text'),
        (1, 'primary_nav', 4, 'https://shop.example/contact', 'Contact', 0, 4, None, False, 'text'),
        (1, 'footer_nav', 0, 'https://shop.example/imprint', 'Imprint', 0, 0, None, False, 'text'),
        (1, 'footer_nav', 1, 'https://facebook.com/shop', 'Facebook', 0, 1, None, True, 'text'),
        (1, 'utility_header', 0, 'tel:5550100', 'Call us', 0, 0, None, False, 'text'),
        (2, 'language_switcher', 0, 'http://blog.example/en', 'English', 0, 0, None, False, 'text'),
        (2, 'language_switcher', 1, 'http://blog.example/fr', 'Français', 0, 1, None, False, 'text'),
    ],
    "breadcrumbs": [
        (1, 0, 'Home', '/'),
        (1, 1, 'Guides', '/guide/'),
        (1, 2, 'Paint', None),
    ],
    "content_links": [
        (1, 0, 'https://shop.example/', 'Walls', 'toc_or_jump', None, 0, False),
        (1, 1, 'https://shop.example/guide/primer', 'a primer', 'contextual_body', 'Walls', 40, False),
        (1, 2, 'https://shop.example/guide/drying', 'drying', 'faq_module', 'Walls', 60, False),
        (1, 3, 'https://shop.example/guide/wallpaper', 'Wallpaper', 'related_posts', 'Doors', 80, False),
        (2, 0, 'http://blog.example/en', 'English', 'contextual_body', 'Third level', 0, False),
        (2, 1, 'http://blog.example/fr', 'Français', 'contextual_body', 'Third level', 50, False),
        (3, 0, 'mailto:a@plain.example', 'mail', 'contextual_body', None, 0, False),
        (3, 1, 'https://cdn.example/x', 'file', 'contextual_body', None, 50, True),
    ],
    "nav_meta": [
        (1, 3, 'header nav > ul', 'footer ul', False),
        (2, 1, None, None, False),
        (5, 0, None, None, False),
        (6, 0, None, None, False),
        (3, 0, None, None, False),
        (4, 0, None, None, False),
    ],
    "links": [
        (1, 0, '/', 'Home', 'nav', None, None, False, 'Home', 'text'),
        (1, 1, '/guide/', 'Guides', 'nav', None, None, False, 'GuidesPaintTools', 'text'),
        (1, 2, '/guide/paint', 'Paint', 'nav', None, None, False, 'Paint', 'text'),
        (1, 3, 'https://other.example/tools', 'Tools', 'nav', None, None, True, 'Tools', 'text'),
        (1, 4, '/contact', 'Contact', 'nav', None, None, False, 'Contact', 'text'),
        (1, 5, 'tel:5550100', 'Call us', 'header', None, None, False, None, 'text'),
        (1, 6, '/', 'Home', 'nav', None, None, False, None, 'text'),
        (1, 7, '/guide/', 'Guides', 'nav', None, None, False, None, 'text'),
        (1, 8, '#walls', 'Walls', 'main', None, None, False, 'Walls', 'text'),
        (1, 9, '#doors', 'Doors', 'main', None, None, False, 'Doors', 'text'),
        (1, 10, '/guide/primer', 'a primer', 'main', None, None, False, 'Matt paint hides what plaster shows, and a primer saves a coat. Roll it on from the window inwards, one wall after the other, and keep a wet edge so that no seams remain where the strokes meet.', 'text'),
        (1, 11, '/guide/drying', 'drying', 'main', None, None, False, 'Four hours, see drying.', 'text'),
        (1, 12, '/guide/wallpaper', 'Wallpaper', 'main', None, None, False, 'Wallpaper', 'text'),
        (1, 13, '/imprint', 'Imprint', 'footer', None, None, False, 'Imprint', 'text'),
        (1, 14, 'https://facebook.com/shop', 'Facebook', 'footer', None, None, True, 'Facebook', 'text'),
        (2, 0, '/en', 'English', 'body', None, None, False, 'EnglishFrançais', 'text'),
        (2, 1, '/fr', 'Français', 'body', None, None, False, 'EnglishFrançais', 'text'),
        (3, 0, 'mailto:a@plain.example', 'mail', 'body', None, None, False, 'No head at all, mail file', 'text'),
        (3, 1, '//cdn.example/x', 'file', 'body', None, None, True, 'No head at all, mail file', 'text'),
    ],
    "filled": [
        (1, '# Choosing paint\n\n# Choosing *paint*\n\n-   [Walls](https://shop.example/guide/paint#walls)\n-   [Doors](https://shop.example/guide/paint#doors)\n\n## Walls\n\nMatt paint hides what plaster shows, and [a primer](https://shop.example/guide/primer) saves a coat. Roll it on from the window inwards, one wall after the other, and keep a wet edge so that no seams remain where the strokes meet.\n\n## Doors\n\nGloss paint wipes clean. Sand the old coat lightly, dust it off and lay the door flat if you can, because a flat door lets the paint level out. Two thin coats are better than a thick one, and a night between them is better than an hour.\n\nHow long does it dry?\n\nFour hours, see [drying](https://shop.example/guide/drying).\n\nCan I paint in winter?\n\nAbove ten degrees.\n\nOrder samples\n\nTools you need: a roller, a tray and tape.\n\nThe best paint I ever used.\n\nIda has painted for thirty years.\n\n[Wallpaper](https://shop.example/guide/wallpaper)', '# Choosing paint\n\n# Choosing *paint*\n\n<!-- STRUCT:TOC:START -->\n-   [Walls](https://shop.example/guide/paint#walls)\n-   [Doors](https://shop.example/guide/paint#doors)\n<!-- STRUCT:TOC:END -->\n\n## Walls\n\nMatt paint hides what plaster shows, and [a primer](https://shop.example/guide/primer) saves a coat. Roll it on from the window inwards, one wall after the other, and keep a wet edge so that no seams remain where the strokes meet.\n\n## Doors\n\nGloss paint wipes clean. Sand the old coat lightly, dust it off and lay the door flat if you can, because a flat door lets the paint level out. Two thin coats are better than a thick one, and a night between them is better than an hour.\n\n<!-- STRUCT:FAQ:START -->\n<!-- STRUCT:FAQ:START -->\n<!-- STRUCT:FAQ:Q -->How long does it dry?\n<!-- STRUCT:FAQ:END -->\n\n<!-- STRUCT:FAQ:START -->\n<!-- STRUCT:FAQ:A -->Four hours, see [drying](https://shop.example/guide/drying).\n<!-- STRUCT:FAQ:END -->\n\n<!-- STRUCT:FAQ:Q -->Can I paint in winter?\n\nAbove ten degrees.\n<!-- STRUCT:FAQ:END -->\n\n<!-- STRUCT:CTA:START -->\nOrder samples\n<!-- STRUCT:CTA:END -->\n\n<!-- STRUCT:ACCORDION:START -->\nTools you need: a roller, a tray and tape.\n<!-- STRUCT:ACCORDION:END -->\n\n<!-- STRUCT:TESTIMONIAL:START -->\nThe best paint I ever used.\n<!-- STRUCT:TESTIMONIAL:END -->\n\n<!-- STRUCT:AUTHOR:START -->\nIda has painted for thirty years.\n<!-- STRUCT:AUTHOR:END -->\n\n<!-- STRUCT:RELATED:START -->\n[Wallpaper](https://shop.example/guide/wallpaper)\n<!-- STRUCT:RELATED:END -->'),
        (2, '# First\n\n# First\n\n### Third level\n\n[English](http://blog.example/en)[Français](http://blog.example/fr)\n\nShort **text** only.', '# First\n\n# First\n\n### Third level\n\n[English](http://blog.example/en)[Français](http://blog.example/fr)\n\nShort **text** only.'),
        (5, 'One plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\n![A door](https://cms.example/i.png) `x`\n\n```sh\nls -l\n```\n\n1.  first\n2.  second\n    -   inner\n\n> Said so.\n\na\n\nb\n\n1\n\n2', 'One plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\nOne plain sentence of the post.\n\n![A door](https://cms.example/i.png) `x`\n\n```sh\nls -l\n```\n\n1.  first\n2.  second\n    -   inner\n\n> Said so.\n\na\n\nb\n\n1\n\n2'),
        (6, 'Top line\n\nLoose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Buy now', 'Top line\n\nLoose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Buy now'),
        (3, 'No head at all, [mail](mailto:a@plain.example) [file](https://cdn.example/x)', 'No head at all, [mail](mailto:a@plain.example) [file](https://cdn.example/x)'),
    ],
}

OVERRIDDEN = [
    (6, 'cms_pattern', 'Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. Loose words without a paragraph around them. '),
    (3, 'fallback', '<p>No head at all, <a href="mailto:a@plain.example">mail</a> <a href="//cdn.example/x">file</a></p>'),
]

_TYPES = {
    "metadata": "id bigint, title varchar, h1 varchar, meta_description varchar, canonical_url varchar, og_image varchar, language varchar, h1_count integer",
    "filled": "id bigint, markdown varchar, markdown_enhanced varchar",
    "headings": "id bigint, pos integer, level integer, text varchar, position integer",
    "elements": "id bigint, pos integer, type varchar, start_index integer, end_index integer, selector varchar, question_count integer, has_schema boolean, questions varchar, item_count integer, link_count integer, is_anchor_based boolean, has_button boolean, has_form boolean, action_text varchar",
    "stats": "id bigint, faq_modules integer, toc_sections integer, breadcrumbs integer, template_ctas integer, accordions integer, testimonials integer, author_bios integer, related_posts integer",
    "content": "id bigint, extraction_method varchar, word_count integer, junk_score double, clean_html varchar",
    "markdown": "id bigint, markdown varchar, markdown_enhanced varchar",
    "menus": "id bigint, list_name varchar, pos integer, url varchar, label varchar, depth integer, sort_order integer, parents varchar, is_external boolean, link_type varchar",
    "breadcrumbs": "id bigint, pos integer, label varchar, url varchar",
    "content_links": "id bigint, pos integer, url varchar, label varchar, source_type varchar, nearest_heading varchar, body_position_pct integer, is_external boolean",
    "nav_meta": "id bigint, clusters_found integer, primary_nav_selector varchar, footer_nav_selector varchar, has_mega_menu boolean",
    "links": "id bigint, pos integer, href varchar, anchor varchar, location varchar, rel varchar, target varchar, is_external boolean, context varchar, link_type varchar",
}


def literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def rows_sql(types: str, rows: list[tuple]) -> str:
    """SQL that gives rows as they stand."""
    names = [t.split()[0] for t in types.split(", ")]
    cast = ", ".join(f"cast({n} as {t.split()[1]}) as {n}" for n, t in zip(names, types.split(", ")))
    return f"select {cast} from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as t({', '.join(names)})"


def pages(spark: SparkSession) -> DataFrame:
    ship_package(spark)
    return spark.createDataFrame(PAGES, "id bigint, final_url string, html_content string")


def _parsed(spark: SparkSession, *parts: str) -> DataFrame:
    return parse_pages(pages(spark), parts=parts)


def fixed_metadata(spark, sf_dir):
    return _parsed(spark, "metadata").filter("metadata is not null").select("id", "metadata.*", "h1_count")


def fixed_headings(spark, sf_dir):
    return _parsed(spark, "metadata").select("id", F.posexplode("headings").alias("pos", "h")).select("id", "pos", "h.*")


def fixed_elements(spark, sf_dir):
    e = _parsed(spark, "structure").select("id", F.posexplode("elements").alias("pos", "e")).select("id", "pos", "e.*")
    return e.withColumn("questions", F.array_join("questions", "|"))


def fixed_structure_counts(spark, sf_dir):
    return _parsed(spark, "markdown").filter("structural_stats is not null").select("id", "structural_stats.*")


def fixed_content(spark, sf_dir):
    return _parsed(spark, "content").select("id", "extraction_method", "word_count", F.round(F.col("junk_score").cast("double"), 4).alias("junk_score"), "clean_html")


def fixed_markdown(spark, sf_dir):
    return _parsed(spark, "markdown").filter("markdown is not null").select("id", "markdown", "markdown_enhanced")


def _menus(n: DataFrame) -> DataFrame:
    out = None
    for name in ("primary_nav", "footer_nav", "utility_header", "language_switcher"):
        rows = n.select("id", F.lit(name).alias("list_name"), F.posexplode(f"nav_structure.{name}").alias("pos", "i")).select("id", "list_name", "pos", "i.url", "i.label", "i.depth", "i.sort_order", F.array_join("i.parent_labels", "|").alias("parents"), "i.is_external", "i.link_type")
        out = rows if out is None else out.unionByName(rows)
    return out


def fixed_menus(spark, sf_dir):
    return _menus(_parsed(spark, "nav"))


def fixed_breadcrumbs(spark, sf_dir):
    return _parsed(spark, "nav").select("id", F.posexplode("nav_structure.breadcrumb").alias("pos", "b")).select("id", "pos", "b.label", "b.url")


def fixed_content_links(spark, sf_dir):
    return _parsed(spark, "nav").select("id", F.posexplode("nav_structure.content_links").alias("pos", "l")).select("id", "pos", "l.*")


def fixed_nav_meta(spark, sf_dir):
    return _parsed(spark, "nav").select("id", "nav_structure.extraction_meta.*").drop("extraction_time_ms")


def fixed_links(spark, sf_dir):
    return _parsed(spark, "links").select("id", F.posexplode("links").alias("pos", "l")).select("id", "pos", "l.*")


#: Places in the first page's source and the kind of block that holds them (the first of several).
PLACES = [("Matt paint", None), ("#walls", "toc_or_jump"), ("Four hours", "faq_module"), ("winter", "faq_module"), ("/guide/\">Guides</a> <span", "breadcrumb"), ("Order samples", "template_cta"), ("roller", "accordion"), ("ever used", "testimonial"), ("thirty", "author_bio"), ("wallpaper", "related_posts"), ("Imprint", None)]


def fixed_kinds_at(spark, sf_dir):
    """Kind of block at places of the first page, by range containment of the detected blocks."""
    source = PAGES[0][2]
    places = spark.createDataFrame([(t, source.index(t)) for t, _ in PLACES], "place string, at int")
    blocks = fixed_elements(spark, sf_dir).filter("id = 1").select("pos", "type", "start_index", "end_index")
    hit = places.join(F.broadcast(blocks), (F.col("at") >= F.col("start_index")) & (F.col("at") < F.col("end_index")), "left")
    return hit.groupBy("place").agg(F.min_by("type", "pos").alias("kind"))


def _stored(spark):
    """The pages as stored rows with their content, and nothing derived from it."""
    made = _parsed(spark, "content").select("id", "clean_html")
    none = {c: F.lit(None).cast(k) for c, k in (("h1", "string"), ("markdown", "string"), ("markdown_enhanced", "string"), ("structural_stats", schemas.STRUCTURAL_STATS), ("nav_structure", schemas.NAV_STRUCTURE))}
    return pages(spark).join(made, "id").withColumns(none)


def fixed_backfill_markdown(spark, sf_dir):
    return backfill.backfill_markdown(_stored(spark))[0].filter("markdown is not null").select("id", "markdown", "markdown_enhanced")


def fixed_backfill_nav(spark, sf_dir):
    return _menus(backfill.backfill_nav(_stored(spark))[0])


def fixed_overrides(spark, sf_dir):
    """Content by a domain's own selectors."""
    o = spark.createDataFrame([("own.example", True, [".none", ".box"], [".ad2"]), ("plain.example", False, ["a"], None)], "domain string, enabled boolean, main_content_selectors array<string>, remove_selectors array<string>")
    return parse_pages(pages(spark), overrides=o, parts=("content",)).filter("id in (3, 6)").select("id", "extraction_method", "clean_html")


QUERIES = {
    f"fixed_{name}": (globals()[f"fixed_{name}"], rows_sql(_TYPES[key], EXPECTED[key]))
    for name, key in (("metadata", "metadata"), ("headings", "headings"), ("elements", "elements"), ("structure_counts", "stats"), ("content", "content"), ("markdown", "markdown"), ("menus", "menus"), ("breadcrumbs", "breadcrumbs"), ("content_links", "content_links"), ("nav_meta", "nav_meta"), ("links", "links"))
} | {
    "fixed_kinds_at": (fixed_kinds_at, rows_sql("place varchar, kind varchar", PLACES)),
    "fixed_backfill_markdown": (fixed_backfill_markdown, rows_sql(_TYPES["filled"], EXPECTED["filled"])),
    "fixed_backfill_nav": (fixed_backfill_nav, rows_sql(_TYPES["menus"], EXPECTED["menus"])),
    "fixed_overrides": (fixed_overrides, rows_sql("id bigint, extraction_method varchar, clean_html varchar", OVERRIDDEN)),
}
