"""Pages written by hand, in layouts unlike those of the training pages, with the texts of their articles' blocks."""

PAGES = [
    (  # a news page of plain divs
        """<!doctype html><html lang=en><head><title>Bridge reopens - The Daily</title><style>p{margin:0}</style></head><body>
<div id="top-navigation"><a href=/>Home</a> <a href=/news>News</a> <a href=/sport>Sport</a></div>
<div class="story-body"><h1>Bridge reopens after two years</h1>
<p class="byline">By Jane Doe</p>
<p>The old bridge over the river was opened to traffic on Monday, after two years of repairs.</p>
<p>&ldquo;We are glad it is over,&rdquo; said the mayor, who cut the ribbon in front of some hundred people.</p>
<p>The work cost nine million, twice what had been planned.</p></div>
<div class="related-stories"><h3>Related</h3><ul><li><a href=/a>Ferry to close</a></li><li><a href=/b>Tolls to rise</a></li></ul></div>
<div class="site-footer"><p>&copy; The Daily. All rights reserved.</p></div></body></html>""",
        ["Bridge reopens after two years", "By Jane Doe", "The old bridge over the river was opened to traffic on Monday, after two years of repairs.", "“We are glad it is over,” said the mayor, who cut the ribbon in front of some hundred people.", "The work cost nine million, twice what had been planned."],
    ),
    (  # a blog in semantic elements, with comments
        """<html><body><header><h1><a href="/">Notes on soup</a></h1><nav><a href="/about">About</a></nav></header>
<main><article><header><h2>Leek soup without cream</h2></header>
<p>Most recipes for leek soup ask for cream. This one does not, and I think it is better for it.</p>
<h3>What you need</h3><ol><li>Three leeks, washed well</li><li>Two potatoes</li><li>A litre of stock</li></ol>
<p>Cut the leeks into rings and fry them slowly. Add the rest, and cook it all for half an hour.</p></article>
<section id="comments"><h3>2 replies</h3><p>Thank you, this was very good!</p><p>I used cream all the same, sorry.</p></section></main>
<aside><h4>Newsletter</h4><form><input type=email><button>Sign up</button></form></aside><footer>Powered by hand.</footer></body></html>""",
        ["Leek soup without cream", "Most recipes for leek soup ask for cream. This one does not, and I think it is better for it.", "What you need", "Three leeks, washed well", "Two potatoes", "A litre of stock", "Cut the leeks into rings and fry them slowly. Add the rest, and cook it all for half an hour."],
    ),
    (  # documentation in a table layout
        """<html><head><title>Options</title></head><body><table width=100%><tr><td class=menu><a href=1>Install</a><br><a href=2>Options</a><br><a href=3>FAQ</a></td>
<td class=content><h1>Options</h1><p>All options may be given in the file or on the command line; the latter wins.</p>
<dl><dt>depth</dt><dd>How many levels are followed. The default is three.</dd><dt>quiet</dt><dd>Print errors only.</dd></dl>
<p>See also the list of questions that are asked often.</p></td></tr></table><div class="cookie-banner">We use cookies. <button>OK</button></div></body></html>""",
        ["Options", "All options may be given in the file or on the command line; the latter wins.", "depth", "How many levels are followed. The default is three.", "quiet", "Print errors only.", "See also the list of questions that are asked often."],
    ),
    (  # an old page without any structure
        """<HTML><BODY BGCOLOR=white><H1>My trip to the lake</H1>
In June we went to the lake for a week.<P>The weather was fine, but for the last two days, when it rained without an end.
<P>We saw a heron, and many ducks.<HR><FORM action=/search>Search this site <INPUT name=q></FORM></BODY></HTML>""",
        ["My trip to the lake", "In June we went to the lake for a week.", "The weather was fine, but for the last two days, when it rained without an end.", "We saw a heron, and many ducks."],
    ),
    (  # a shop's article with share buttons and a notice inside
        """<body><div role="banner"><a href="/">Shop</a></div><div class="entry-content"><h1>How to choose a tent</h1>
<div class="social-share"><a href=#>Tweet</a><a href=#>Post</a></div>
<p>A tent should be a little larger than you think. Two people want room for three.</p>
<div class="newsletter-popup"><p>Get ten percent off your first order!</p></div>
<blockquote>The best tent is the one that you can put up in the rain.</blockquote>
<p>Look at the seams, the poles and the weight, in this order.</p></div>
<div class="recommended-products"><a href=/t1>Tent one</a> <a href=/t2>Tent two</a></div><div class="footer-links"><a href=/imprint>Imprint</a></div></body>""",
        ["How to choose a tent", "A tent should be a little larger than you think. Two people want room for three.", "The best tent is the one that you can put up in the rain.", "Look at the seams, the poles and the weight, in this order."],
    ),
    (  # a forum's guide in nested sections, with code references and an advert
        """<div class=wrap><div class=masthead>Forum</div><section class=post><h2>Fixing a slow disk</h2><p>First, see whether it is the disk at all: <code>iostat -x 5</code> shows it.</p>
<div class="ad-slot"><a href=x>Faster disks here</a></div><p>If it waits more than it works, look at the cable &amp; the log.</p></section>
<section class="discussion"><div class=reply><p>Worked for me, thanks a lot.</p></div></section></div>""",
        ["Fixing a slow disk", "First, see whether it is the disk at all: iostat -x 5 shows it.", "If it waits more than it works, look at the cable & the log."],
    ),
]
