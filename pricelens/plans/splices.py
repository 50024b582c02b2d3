"""Text spliced into the stand-in rows so that every rule meets its cases.

The driver's texts hold no listing prices, batteries or listing links, so the
stand-in views put some in, chosen by the row's id and built around the row's
own values.  Each constant is SQL that Spark and DuckDB both read; the oracle
states what must come out of a splice from the same ids, not by parsing it.
"""

HOST = "split_part(split_part(url, '://', 2), '/', 1)"
_P = "CAST({} AS STRING)"


def _n(e: str) -> str:
    return f"CAST({e} AS STRING)"


#: Put before a captured page; the case is ``page_id % 6``.
CARDS = f"""CASE page_id % 6
WHEN 0 THEN concat('<article><a href="/recommerce/forsale/item/', {_n('100000000 + page_id')}, '"><h2>Ting <i>', {_n('page_id')}, '</i> fra ', {HOST},
  '</h2></a><div data-testid="price-box"><b>', {_n('page_id % 9 + 1')}, '</b> 500 kr</div><div data-testid="location"><svg></svg><span>Oslo, ', {HOST},
  '</span></div><img data-src="https://images.finncdn.no/dynamic/1x1/', {_n('page_id')}, '.jpg"><p>Pent brukt</p></article>')
WHEN 1 THEN '<article><a href="https://evil.example.org/item/1234567"><h2>Bort</h2></a></article>'
WHEN 2 THEN concat('<article><A HREF=https://www.finn.no/bap/forsale/ad.html?finnkode=', {_n('page_id + 123456789')}, '>x</A><H3>S&oslash;ker &#8211; ', {_n('page_id')},
  '</H3><span class="a t3">', {_n('page_id')}, ' kr</span><span class="my-location">12 Oslo</span><div class="address"><b>Bergen</b><br>5003</div><img src="http://images.finncdn.no/x.jpg"></article>')
WHEN 3 THEN concat('<article><a href="/bap/', {_n('page_id + 7000000')}, '"><div>Ting ', {_n('page_id')}, '</div></a><div class="flex between"><span>for</span><span>Troms&oslash;</span></div><span>',
  {_n('page_id % 5 + 1')}, ' 000 kr</span></article>')
WHEN 5 THEN concat('<a id="bap-', {_n('page_id')}, '" href="/recommerce/forsale/item/', {_n('200000000 + page_id')}, '"><h3>Uten kort ', {_n('page_id')}, '</h3><span>', {_n('page_id')}, ' 000 kr</span></a>')
ELSE '' END"""
#: The captured page: cards first; case 5 has no article of its own.
HTML = f"concat({CARDS}, CASE WHEN page_id % 6 = 5 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>') ELSE html END)"

#: Put before a detail page; the case is ``page_id % 7``.
DETAILS = f"""CASE page_id % 7
WHEN 0 THEN concat('<div data-testid="description"><p>Selges fra ', {HOST}, ' som ny</p></div><dl><dt>Sted</dt><dd>Bod&oslash;<br>8000</dd></dl>')
WHEN 1 THEN concat('<div data-testid="description">kort</div><div class="x whitespace-pre-wrap">Annonse <b>', {_n('page_id')}, '</b> fra ', {HOST}, '</div><span data-testid="location">Oslo</span>')
WHEN 2 THEN concat('<section><h2>Full beskrivelse</h2><div>Lang tekst om ', {HOST}, '</div></section><table><tr><th>Sted</th><td>Alta</td></tr></table>')
WHEN 3 THEN '<div data-testid="description">kort</div><div><span>Sted</span><span>Voss</span></div>'
ELSE '' END"""
DETAIL_HTML = f"concat({DETAILS}, html)"

#: Links of captured searches; the case is ``page_id % 3``.
LISTING_URL = f"""CASE page_id % 3 WHEN 0 THEN url
WHEN 1 THEN concat('https://www.finn.no/recommerce/forsale/item/', {_n('100000000 + page_id')})
ELSE concat('https://www.finn.no/bap/ad.html?finnkode=', {_n('500000 + page_id')}, '&x=1') END"""

#: Around the text of a document.
POST_TITLE = "concat(CASE WHEN doc_id % 11 = 0 THEN '=SUM(1) ' ELSE '' END, {title}, CASE doc_id % 5 WHEN 0 THEN ' 128 GB' WHEN 1 THEN ' 64GB' ELSE '' END)"
POST_TEXT = """concat(text, CASE doc_id % 7 WHEN 0 THEN ' Pent brukt, kvittering' WHEN 1 THEN ' Knust skjerm, batteri 87 %' WHEN 2 THEN ' batterihelse 100%'
WHEN 3 THEN ' 45 % slitt, riper' ELSE '' END)"""
#: A listing's text by the number of its observation.
LISTING_TEXT = "CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN 'pent brukt med kvittering' WHEN 2 THEN 'knust, batteri 87 %' ELSE 'batteri 95%' END"
#: A review's raw condition by its document: words, long numbers and decimals among the numbers.
CONDITION = "CASE doc_id % 9 WHEN 0 THEN 'bad' WHEN 1 THEN '11111111111111111111' WHEN 2 THEN '7.5' WHEN 3 THEN '-99999999999999999999' ELSE CAST(quality * 14 - 2 AS STRING) END"
