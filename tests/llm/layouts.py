"""Pages written and labelled by hand: what stands between {{ and }} is a block of the main text."""

PAGES = [
    # plain news
    """<!doctype html><html lang=en><head><title>Bridge reopens</title></head><body><header class="site-top"><a href=/>The Daily Note</a></header>
    <nav><ul><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li></ul></nav>
    <article><h1>{{Bridge reopens after two years}}</h1><p>{{The bridge over the river opened to traffic on Monday, two years after the flood.}}</p>
    <p>{{Engineers replaced four pillars, and the city paid for new lights.}}</p><h2>{{What it cost}}</h2><p>{{The work cost nine million, a third more than planned.}}</p></article>
    <aside><h3>Most read</h3><ul><li><a href=/1>Rain expected</a></li><li><a href=/2>Team wins again</a></li></ul></aside><footer>&copy; The Daily Note. All rights reserved.</footer></body></html>""",
    # blog with comments below the article
    """<html><body><div id="masthead"><p>Notes from a small kitchen</p></div><main><article><h1>{{Bread without kneading}}</h1>
    <p>{{Mix flour, water, salt and a little yeast in the evening.}}</p><p>{{In the morning the dough has doubled; fold it twice and let it rest.}}</p>
    <ul><li>{{500 g flour}}</li><li>{{350 g water}}</li><li>{{a pinch of yeast}}</li></ul></article></main>
    <section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>Great, mine came out well!</p></div><div class="comment"><b>Bo</b><p>How long do you bake it?</p></div></section>
    <footer><a href=/about>About</a> <a href=/feed>Feed</a></footer></body></html>""",
    # no head end, unclosed paragraphs
    """<html><head><title>Old page</title><meta name=x><body><nav><a href=a>Home</a> <a href=b>Up</a></nav><article><h1>{{How the clock was built}}</h1>
    <p>{{The first clock stood in the tower for a hundred years.}}<p>{{It was sold, and nobody knows where it went.}}<p>{{A new one came in 1921.}}</article><footer>Last changed 1999</footer>""",
    # main without article, cookie notice first
    """<body><div class="cookie-consent"><p>We use cookies to improve your visit.</p><button>Accept</button></div><div class="navbar"><a href=/>Home</a><a href=/docs>Docs</a></div>
    <main><h1>{{Installing the tool}}</h1><p>{{Download the archive and unpack it anywhere you like.}}</p><pre>{{tar xf tool.tar && cd tool && make}}</pre><p>{{Run the tests before you use it.}}</p></main>
    <div class="footer">Imprint</div></body>""",
    # hidden notice, form inside the article
    """<body><header><h2>City library</h2></header><article><h1>{{New opening hours}}</h1><p>{{From May on the library opens at nine.}}</p><form><label>Your mail</label><input name=m><button>Subscribe</button></form>
    <p>{{On Sundays it stays closed.}}</p></article><div style="display:none"><p>Sign up today and save!</p></div><footer>City of Elm</footer></body>""",
    # entities, inline markup, line breaks
    """<body><nav><ul><li><a href=x>Start</a></ul></nav><article><h1>{{Caf&eacute; &amp; bar}}</h1><p>{{It opens at <b>seven</b>, <i>every</i> day&hellip;}}<br>{{and closes when the last guest leaves.}}</p></article><footer>&copy; 2020</footer></body>""",
    # quotes and lists
    """<body><header class="header"><a href=/>Reader</a></header><article class="post"><h1>{{On walking}}</h1><blockquote><p>{{I have walked myself into my best thoughts.}}</p></blockquote>
    <p>{{So he wrote in a letter, and he meant it.}}</p><ol><li>{{Leave early.}}</li><li>{{Take no map.}}</li></ol></article><div class="related"><h4>Related</h4><a href=/r>On running</a></div><footer>Reader, a magazine</footer></body>""",
    # advert between paragraphs
    """<body><article><h1>{{Storm hits the coast}}</h1><p>{{The storm reached the coast in the night, with winds of 130 km an hour.}}</p><div class="advert"><p>Buy now, pay later, only today.</p></div>
    <p>{{No one was hurt, but many roofs are gone.}}</p></article><aside class="sidebar"><p>Weather for the week</p></aside><footer>Contact us</footer></body>""",
    # custom elements and a self-closed drawing
    """<body><svg-icon></svg-icon><svg width="4" height="4"/><template-part></template-part><nav><a href=/>Go</a></nav><article><h1>{{Seven birds of the lake}}</h1><p>{{The heron stands still for hours, and then it does not.}}</p></article><footer>Bird club</footer></body>""",
    # html with misleading classes
    """<html class="no-js modal-none"><body class="page menu-closed"><nav><a href=/>Top</a></nav><article><h1>{{Tax rules change in June}}</h1><p>{{Households that earn little pay less from June on.}}</p><p>{{Others pay as before.}}</p></article><footer>Ministry</footer></body></html>""",
    # drawing that holds text, script between paragraphs
    """<body><article><h1>{{The metro map}}</h1><svg><title>map</title><text>Line 1</text></svg><p>{{The map was drawn in 1933, and it is still in use.}}</p><script>var x = "<p>not this</p>";</script><p>{{Distances on it are not true.}}</p></article><footer>Transport museum</footer></body>""",
    # several sections in main, breadcrumbs before
    """<body><nav class="breadcrumbs"><a href=/>Home</a> &raquo; <a href=/g>Guide</a></nav><main><section><h1>{{Keeping bees}}</h1><p>{{A hive needs sun in the morning and shade at noon.}}</p></section>
    <section><h2>{{Spring}}</h2><p>{{Look into the hive on the first warm day.}}</p></section><section><h2>{{Autumn}}</h2><p>{{Feed them sugar, and leave them alone.}}</p></section></main><footer><ul><li><a href=/i>Imprint</a></li></ul></footer></body>""",
    # table of facts in the article
    """<body><header>Atlas</header><article><h1>{{Lake Orr}}</h1><p>{{Lake Orr is the second largest of the region.}}</p><table><tr><th>{{Depth}}</th><td>{{61 m}}</td></tr><tr><th>{{Area}}</th><td>{{12 km2}}</td></tr></table></article><footer>Atlas of lakes</footer></body>""",
    # newsletter box inside main
    """<body><main><article><h1>{{Why the price of milk rose}}</h1><p>{{Feed is dear, and there are fewer cows.}}</p><div class="newsletter"><p>Get our letter every Friday.</p><button>Join</button></div><p>{{Farmers ask for help from the state.}}</p></article></main><footer>Farm weekly</footer></body>""",
    # share links and byline
    """<body><article><h1>{{A night at the opera}}</h1><div class="byline">By Clara Holm</div><div class="share"><a href=t>Tweet</a><a href=f>Post</a></div><p>{{The singer lost her voice in the second act.}}</p><p>{{The house stood up and sang for her.}}</p></article><footer>Culture desk</footer></body>""",
    # shouting and symbols in the text
    """<body><nav><a href=/>Forum</a></nav><article><h1>{{RESULTS OF THE RAFFLE}}</h1><p>{{FIRST PRIZE | a bicycle | number 1204}}</p><p>{{Second prize: dinner for two ### number 77}}</p></article><footer>Club</footer></body>""",
    # a deep stack of plain boxes
    """<body><div class=a><div class=b><header><a href=/>Home</a></header><div class=c><article><div><div><h1>{{Mending a chair}}</h1><div><p>{{Take out the old glue before you put in the new.}}</p><p>{{Press it for a day.}}</p></div></div></div></article></div></div></div><footer>Workshop</footer></body>""",
    # figure with caption in the article
    """<body><header>Photo</header><article><h1>{{Light in winter}}</h1><figure><img src=x><figcaption>{{The harbour at noon in January.}}</figcaption></figure><p>{{The sun stays low, and shadows are long.}}</p></article><footer>Photo club</footer></body>""",
    # definition list
    """<body><nav><a href=/>A-Z</a></nav><main><h1>{{Words of the sea}}</h1><dl><dt>{{Lee}}</dt><dd>{{the side away from the wind}}</dd><dt>{{Reef}}</dt><dd>{{to make a sail smaller}}</dd></dl></main><footer>Harbour office</footer></body>""",
    # nothing but clutter
    """<body><nav><ul><li><a href=/>Home</a></li><li><a href=/c>Cart</a></li></ul></nav><aside><p>Only today: half price.</p></aside><form><label>Search</label><input></form><footer>&copy; Shop</footer></body>""",
]
