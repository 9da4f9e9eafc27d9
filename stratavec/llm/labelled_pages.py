"""Labelled pages for the weights of HTML extraction: their article is between the marks [[ and ]]."""

PAGES = [
    """<html><head><title>A day by the sea</title><style>p{margin:0}</style></head><body><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Travel</a></li></ul></nav><div class="ad">Buy two umbrellas now and save a third of the price.</div>[[<article><h1>A day by the sea</h1><p>We set out before dawn with bread and cheese in the basket and walked along the cliff until the fog had gone.</p><p>By noon the tide was out and the children were looking for crabs among the rocks near the old harbour wall.</p><p>In the evening we sat on the pier and watched the boats come home one after the other.</p></article>]]<footer>&copy; example.com &middot; all rights reserved</footer></body></html>""",
    """<html><body><header><a href="/">Home</a> <a href="/about">About us</a> <a href="/contact">Contact</a></header><div id="cookie-notice">We use cookies. <button>Accept</button> <a href="/privacy">More</a></div><div class="wrap"><div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten ways to bake</a></li><li><a href="/2">The best of spring</a></li><li><a href="/3">Why we left town</a></li></ul></div>[[<div class="post-content"><h2>How the mill was built</h2><p>The mill stands where the river bends, and its wheel has turned for nearly three hundred years without a longer pause than one winter.</p><p>Oak for the beams came down the river in spring, when the water was high enough to carry whole trunks past the rapids.</p><blockquote><p>It was the work of two generations, as the miller liked to say.</p></blockquote><p>Only the roof has been replaced since then, after the storm that took half the village's chimneys with it.</p></div>]]</div><div class="comments"><h3>3 comments</h3><p>Great read!</p><p>Thanks for this.</p><form><textarea></textarea><button>Send</button></form></div><footer><a href="/imprint">Imprint</a> <a href="/terms">Terms</a></footer></body></html>""",
    """<html><body><div class="menu"><a href="/">Start</a> | <a href="/shop">Shop</a> | <a href="/blog">Blog</a></div>[[<main><h1>Repairing a bicycle tube</h1><p>First take the wheel off and let out what air is left, then lift the tyre over the rim with two levers.</p><ul><li>Find the hole by holding the tube under water.</li><li>Roughen the rubber around it and wait until the glue is dry to the touch.</li></ul><p>Press the patch on firmly, put everything back and pump it up again slowly while you check the seat of the tyre.</p></main>]]<div class="related"><a href="/x">Choosing a saddle</a> <a href="/y">Winter tyres</a></div><div class="newsletter"><form>Subscribe <input><button>Go</button></form></div><footer>Imprint</footer></body></html>""",
    """<html><body><table><tr><td><a href="/1">Index</a><br><a href="/2">Archive</a><br><a href="/3">Links</a></td><td>[[<p>The council met on Tuesday to discuss the new bridge, which is to replace the ferry that has crossed here since the war.</p><p>Most speakers agreed that the ferry cannot carry the traffic any longer, though some asked who would pay for the approach roads.</p><p>A decision is expected before the summer, once the report on the ground under the northern bank has been read.</p>]]</td></tr></table><p><small><a href="/print">Print</a> <a href="/mail">Mail</a></small></p></body></html>""",
    """<html lang="de"><body><nav><a href="/">Start</a><a href="/wir">Wir</a></nav><div class="banner">Jetzt sparen!</div>[[<article><h1>Im Moor</h1><p>Am Morgen lag der Nebel so dicht, dass man den Weg nur am Klang der Schritte auf den Bohlen erkennen konnte.</p><p>Erst gegen Mittag kam die Sonne durch, und mit ihr kamen die Libellen und das Geschrei der Kraniche im Westen.</p></article>]]<aside><p>Mehr zum Thema</p><a href="/1">Vögel</a><a href="/2">Pflanzen</a></aside><footer>Impressum</footer></body></html>""",
    """<html lang="fr"><body><div class="header"><a href="/">Accueil</a><a href="/fr">Actualités</a></div>[[<div class="article-body"><h1>Le vieux pont</h1><p>Le pont a été construit par des maçons venus de la vallée voisine, qui ont taillé chaque pierre sur place avant de la poser.</p><p>Après la crue de printemps il fallut refaire deux arches, mais le reste a tenu, et l'on passe encore dessus aujourd'hui.</p></div>]]<div class="share"><a href="#">Partager</a><a href="#">Imprimer</a></div><div class="advert">Offre spéciale</div><footer>Mentions légales</footer></body></html>""",
    """<html><body><div><a href="/">Harbour News</a></div><div>Monday edition</div><div>We use cookies to improve this site. By going on you agree.</div>[[<div><h1>Ferry returns to service</h1><p>The ferry sailed again on Friday, three weeks after a broken shaft had kept it at the quay for the first time in years.</p><p>Passengers were glad of it, since the way round the bay takes two hours by bus and the last one leaves at six.</p></div>]]<div>Share this page</div><div>Copyright 2021 Harbour News</div><div>All prices include tax. Offers end on Sunday.</div></body></html>""",
    """<html><body><table><tr><td colspan="2">Rose's garden pages</td></tr><tr><td><ul><li><a href="/r">Roses</a></li><li><a href="/h">Herbs</a></li></ul></td><td>[[<h2>Pruning in spring</h2><p>Cut back to an outward bud when the forsythia is in flower, and take out all wood that has died in the frost.</p><p>A clean and slanting cut lets the rain run off, so that it does not rot.</p><ul><li>Sharpen the shears first.</li><li>Burn whatever looks ill.</li></ul>]]</td></tr><tr><td colspan="2">Visitors so far: 4711</td></tr><tr><td>Last change in May</td></tr></table></body></html>""",
    """<html><body><p><a href="/">Up</a> <a href="/2">Next</a></p>[[<h1>On the use of tar</h1><p>Tar keeps wood from rotting, and has been boiled from pine roots for as long as ships were built here.</p><h2>How it is made</h2><p>The roots are split, stacked in a pit with a drain at its lowest place, covered with turf and lit from above.</p><p>After some days the first drops run; by then the fire must be watched day and night.</p>]]<p>Page 3 of 12</p><p>Printed version</p><p><a href="/imprint">Imprint</a></p></body></html>""",
]
