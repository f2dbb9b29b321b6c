"""Goldens of HTML as Markdown."""

import pytest

from paperloom.sources.html_tree import markdown_of


@pytest.mark.parametrize(("page", "markdown"), [
    ("<ol><li>a</li><li>b<ul><li>c</li><li>d</li></ul></li><li>e</li></ol>", "1. a\n2. b\n   - c\n   - d\n3. e"),
    ("<ul>\n <li>a</li>\n <li>b</li>\n</ul>\n<p>c", "- a\n- b\n\nc"),
    ("<ol start=4><li>a<li>b</ol>", "4. a\n5. b"),
    ("<ul><li><p>one</p><p>two</p></li><li>three</li></ul>", "- one\n\n  two\n- three"),
    ("<ul><li>a<ol><li>x<ul><li>deep</li></ul></li></ol></li></ul>", "- a\n  1. x\n     - deep"),
    ("<pre>  if x:\n    $y\n\n\n\n  z</pre>after", "```\n  if x:\n    $y\n\n\n\n  z\n```\n\nafter"),
    ("<pre><code>a\n b</code></pre>", "```\na\n b\n```"),
    ("use <code>a $b *c*</code> now", "use `a $b *c*` now"),
    ("<blockquote><p>a</p><p>b <i>c</i></p></blockquote>d", "> a\n>\n> b *c*\n\nd"),
    ("<blockquote>a<blockquote>b</blockquote></blockquote>", "> a\n>\n> > b"),
    ("<blockquote><pre>x\n y</pre></blockquote>", "> ```\n> x\n>  y\n> ```"),
    ("<ul><li>see<pre>x\n y</pre></li></ul>", "- see\n\n  ```\n  x\n   y\n  ```"),
    ("x <img src='a (1).png' alt='A'> y <img alt='none'>", "x ![A](a (1).png) y"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<b> bold </b>x<b></b>", "**bold** x"),
    ("a<b>b", "a**b**"),
    ("</p></b>text</div>", "text"),
    ("<span id='p1'>t</span> <span>u</span>", '<span id="p1">t</span> u'),
    ("<p class='has-continuation'>exam-</p><p>ple</p>", "exam\n\nple"),
    ("<table><tr><td><ul><li>in</li></ul>$1</td><td><b>x</b></td></tr></table>", "| in\\$1 | x |\n| --- | --- |"),
    ("<table><tr><td>never ends", "| never ends |\n| --- |"),
    ("<style>p{}</style><script>if (a<b) {}</script>ok", "ok"),
    ("&lt;b&gt; &amp;amp; 5 &lt; 6", "<b> &amp; 5 < 6"),
    ("\0\1 1\1x", "1x"),
    ("a <math>x<y</math>", "a $x$"),
])
def test_markdown(page, markdown):
    assert markdown_of(page) == markdown
