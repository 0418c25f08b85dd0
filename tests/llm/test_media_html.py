import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidetrace.llm import html as H
from sidetrace.llm import media as M
from tests.llm.helpers import HARD, documents


def test_decoders():
    r = np.random.default_rng(1)
    grey, rgb = r.integers(0, 256, (7, 5), np.uint8), r.integers(0, 256, (6, 3, 3), np.uint8)
    assert (M.decode(M.encode_pgm(grey))[:, :, 0] == grey).all()
    assert (M.decode(M.encode_bmp(grey))[:, :, 0] == grey).all() and (M.decode(M.encode_bmp(rgb)) == rgb).all()
    assert (M.decode(b"P6 # note\n3 6\n255\n" + rgb.tobytes()) == rgb).all()
    assert (M.decode(b"P3\n3 6 255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    assert M.decode(b"P1\n3 1\n1 0 1")[0, :, 0].tolist() == [0, 255, 0] and M.decode(b"P4\n3 1\n\xa0")[0, :, 0].tolist() == [0, 255, 0]
    assert M.decode(b"P5 1 1 65535\n\x01\x02")[0, 0, 0] == 258
    for bad in (b"", b"P5", b"P5 0 1 255\n", b"P5 9 9 255\nxx", b"BM", b"GIF89a"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            M.decode(bad)


def test_area_resize_equals_means():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8, 1)
    assert np.allclose(M.area_resize(image, 3, 4)[:, :, 0], image[:, :, 0].reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert np.allclose(M.area_resize(image, 1, 1), image.mean()) and np.allclose(M.area_resize(image, 6, 8), image)
    up = M.area_resize(image[:1, :1], 3, 3)
    assert np.allclose(up, image[0, 0, 0])
    assert (np.load(io.BytesIO(M.npy(image))) == image).all()


def plain_resize(image, height, width):
    """Each output sample as a sum over all input samples, weighted by the shared area."""
    h, w, c = image.shape
    out = np.zeros((height, width, c))
    for i in range(height):
        for j in range(width):
            for y in range(h):
                for x in range(w):
                    a = max(0.0, min((i + 1) * h / height, y + 1) - max(i * h / height, y))
                    b = max(0.0, min((j + 1) * w / width, x + 1) - max(j * w / width, x))
                    out[i, j] += a * b * image[y, x]
    return out * height * width / (h * w)


def test_resize_and_difference_hash_equal_brute_force():
    r = np.random.default_rng(2)
    for h, w, c in ((1, 1, 1), (5, 7, 3), (13, 4, 1), (3, 64, 1), (20, 11, 1)):
        image = r.integers(0, 256, (h, w, c), np.uint8)
        for size in ((8, 9), (3, 2), (8, 8)):
            assert np.allclose(M.area_resize(image, *size), plain_resize(image, *size))
        small = plain_resize(image, 8, 9).mean(axis=2).round(6)
        bits = "".join("1" if small[i, j] < small[i, j + 1] else "0" for i in range(8) for j in range(8))
        assert M.difference_hash(image) == f"{int(bits, 2):016x}"


def test_digests_of_broken_media(spark):
    df = spark.createDataFrame([(1, 3, None), (2, 3, bytearray(b"xx"))], "doc_id long, n_bytes long, media binary")
    assert [(r.n_bytes, r.payload_sha256, r.tile) for r in M.digests(df).collect()] == [(3, None, None)] * 2


def test_tiles_keep_broken_rows(spark):
    good = M.encode_pgm(np.tile(np.arange(64, dtype=np.uint8), (64, 1)))
    df = spark.createDataFrame([(1, good), (2, None), (3, b"xx"), (4, M.encode_bmp(np.zeros((2, 2, 3), np.uint8)))], "doc_id long, media binary").withColumn("tile", F.lit("clash"))
    rows = {r.doc_id: r for r in M.tiles(df, "doc_id").collect()}
    assert rows[1].dhash == "ff" * 8 and rows[4].channels == 3 and rows[2].tile is None and rows[3].dhash is None
    assert np.load(io.BytesIO(bytes(rows[1].tile))).shape == (8, 8, 1)


def test_texts_come_back(spark):
    docs = documents(spark, HARD).withColumn("feature", F.lit("clash"))
    rows = {r.doc_id: r for r in M.digests(M.store_text(docs)).collect()}
    for i, t in enumerate(HARD):
        raw = (t or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (rows[i].media_bytes, rows[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[8].feature == rows[9].feature and M.digests(M.store_text(docs.limit(0))).count() == 0


PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header class="site-header"><a href=/>Logo</a></header>
<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div id="cookie-notice">We use cookies. OK?</div>
<main><article><h1>Big &amp; title</h1><p>First  paragraph with <a href=x>a link</a> inside<br>and a break; it goes on for a while.
<p>Second &lt;one&gt; &#233; with <b>bold</b> words and some more of them.<script>var t="</p>";</script><div class="ad">Buy now!</div>
<ul><li>one item<li>two items</ul><blockquote>Quote</blockquote></article></main><!-- <p>no</p> -->
<aside class="sidebar"><h3>Related</h3><a href=1>A long headline here</a></aside><section id="comments"><div class="comment"><p>Nice article, I liked it.</p></div></section>
<form><label>Mail</label><input><button>Go</button></form><footer><p>&copy; us</p></footer></body></html>"""
TEXT = "Big & title\nFirst paragraph with a link inside and a break; it goes on for a while.\nSecond <one> é with bold words and some more of them.\none item\ntwo items\nQuote"


def test_article_alone():
    m = H.trained()
    assert H.extract(PAGE, m) == TEXT and H.extract(None, m) == H.extract("", m) == H.extract("<p", m) == ""
    assert H.extract(PAGE.replace("</html>", "").replace("</body>", ""), m) == TEXT
    deep = "<article>" + "<div>" * 3000 + "<p>deep words in a paragraph" + "</div>" * 3000
    assert H.extract(deep, m) == "deep words in a paragraph"


P = 'The first sentence of the story goes on for a good while and says what there is to say about it. '
Q = 'Another part follows with more words, some of them long, and it ends where the author ran out of things to tell.'
LONG = (P + Q + ' ').strip() + ' ' + ((P + Q + ' ') * 5).strip()
MENU = '<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About</a></li></ul></nav>'
FOOT = '<footer>&copy; example.net</footer>'
P = P.strip()
LAYOUTS = {
    'attr value hidden': (f'<body>{MENU}<article title="The hidden cost of x"><p>{P}</p><p>{Q}</p></article>{FOOT}', f'{P}\n{Q}'),
    'data label': (f'<body>{MENU}<article data-label="a hidden gem"><p>{P}</p></article>{FOOT}', P),
    'p title': (f'<body>{MENU}<article><p>{P}</p><p title="some hidden thing">{Q}</p></article>{FOOT}', f'{P}\n{Q}'),
    'really hidden': (f'<body>{MENU}<article><p>{P}</p><p hidden>{Q}</p><p style="color:red; display:none">x</p><p aria-hidden=true>y</p></article>{FOOT}', P),
    'one long p': (f'<body>{MENU}<article><p>{LONG}</p></article>{FOOT}', LONG),
    'one long p br': (f'<body>{MENU}<article><p>{P}<br>{Q}<br>{LONG}</p></article>{FOOT}', f'{P} {Q} {LONG}'),
    'loose article': (f'<body>{MENU}<article>{P}<br><br>{Q}</article>{FOOT}', f'{P} {Q}'),
    'heading and two p': (f'<body>{MENU}<h1>Title words</h1><p>{P}</p><p>{Q}</p>{FOOT}', f'Title words\n{P}\n{Q}'),
    'alone in body': (f'<body><h1>Title words</h1><p>{P}</p><p>{Q}</p></body>', f'Title words\n{P}\n{Q}'),
    'in a div': (f'<body>{MENU}<div><h1>Title words</h1><p>{P}</p><p>{Q}</p></div>{FOOT}', f'Title words\n{P}\n{Q}'),
    'nested divs': (f'<body><div><div><div><div><p>{P}</p><p>{Q}</p></div></div></div></div>{FOOT}', f'{P}\n{Q}'),
    'divs as blocks': (f'<body>{MENU}<div><div>{P}</div><div>{Q}</div></div>{FOOT}', f'{P}\n{Q}'),
    'plain text': (f'<body>{LONG}</body>', LONG),
    'plain text br': (f'<html><body>{P}<br>{Q}</body></html>', f'{P} {Q}'),
    'table': (f'<body><table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td><h1>Title words</h1><p>{P}</p><p>{Q}</p></td></tr></table></body>', f'Title words\n{P}\n{Q}'),
    'table text': (f'<body><table><tr><td><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></td><td>{P}<br>{Q}</td></tr></table></body>', f'{P} {Q}'),
    'main section': (f'<body><header><h1>Site name</h1></header>{MENU}<main><section><h2>Part</h2><p>{P}</p></section><section><p>{Q}</p></section></main>{FOOT}', f'Part\n{P}\n{Q}'),
    'div class': (f'<body><div id="header">Site</div><div class="menu"><a href=a>Home</a></div><div class="post-content"><p>{P}</p><p>{Q}</p></div><div class="sidebar"><h3>Related</h3><p>Other story</p></div><div id="footer">foot</div></body>', f'{P}\n{Q}'),
    'comments': (f'<body>{MENU}<article><h1>Title words</h1><p>{P}</p><p>{Q}</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>{Q}</p></div></section>{FOOT}', f'Title words\n{P}\n{Q}'),
    'deep': ('<article>'+'<div>'*3000+f'<p>{P}'+'</div>'*3000, P),
    'short deep': ('<article>'+'<div>'*3000+'<p>deep words in a paragraph'+'</div>'*3000, 'deep words in a paragraph'),
    'lists': (f'<body>{MENU}<article><p>{P}</p><ol><li>{P}<li>{Q}</ol></article>{FOOT}', f'{P}\n{P}\n{Q}'),
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    page, text = LAYOUTS[name]
    assert H.extract(page, H.trained()) == text


def test_attributes_count_by_name():
    assert H.told(' title="hidden display:none" data-x=hidden')[0] is False and H.told(" HIDDEN")[0] and H.told(" style='a:b;display : none'")[0] and H.told(" aria-hidden='true'")[0]
    assert H.told(' class="mainNav x" data-id="footer"')[1] == H.told(" id=nav role=main")[1]


def test_messages_equal_enumeration():
    """Marginals by messages are those of the joint distribution."""
    m = H.trained()
    root = H.parse("<div><p>some words in here</p><ul><li><a>x</a></ul></div>")
    nodes = H.nodes_of(root)
    u = H.potentials(nodes) @ m.weights
    total, on = 0.0, np.zeros(len(nodes))
    for k in range(1 << len(nodes)):
        s = [(k >> i) & 1 for i in range(len(nodes))]
        w = np.exp(sum(-np.log1p(np.exp(-u[i] if s[i] else u[i])) for i in range(len(nodes))) + sum(m.edges[s[x.parent.order], s[x.order]] for x in nodes if x.parent))
        total += w
        on += w * np.array(s)
    assert np.allclose(m.marginals(nodes), on / total, atol=1e-6)


def test_held_out_accuracy():
    m, r = H.trained(), random.Random(12345)
    right = n = 0
    for _ in range(150):
        nodes = H.nodes_of(H._labelled(r))
        p = m.marginals(nodes) >= 0.5
        for x in nodes:
            if any(isinstance(t, str) for t in x.text):
                right += p[x.order] == x.content
                n += 1
    assert right / n > 0.95


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = H.extract_pages(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in rows) == [("1", len(TEXT)), ("1", len(TEXT)), ("2", 0), ("None", 0)]
    assert H.extract_pages(df.limit(0)).count() == 0


def test_hidden_elements_whose_end_tags_are_left_out():
    def text(page):
        return " ".join(t.strip() for x in H.nodes_of(H.parse(page)) for t in x.text if isinstance(t, str) and t.strip())

    assert text("<html><head><title>x</title><body><article>aa</article>") == "aa" and text("<head><meta a><title>x</title><p>aa</p>") == "aa"
    assert text("<head><script>for(i=0;i<n; i++) // don't\n</script></head><body><p>it's ok</p>") == "it's ok"
    assert text("<div><p hidden>aa<div>bb</div></div><div><p hidden>x</div>cc") == "cc bb"
    assert text("<ul><li hidden>x<ul><li>y</li></ul><li>z</ul>after") == "after z"
    assert text("<table><tr><td hidden>a<td>b</table>") == "b" and text("<div hidden><p>x</p><div>y</div></div>z") == "z"
