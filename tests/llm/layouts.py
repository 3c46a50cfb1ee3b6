"""Page layouts labelled by hand: [mK] stands for K words of main text, [nK] for K words of anything else."""

LAYOUTS = [
    # plain articles in the common elements
    "<body><article><h1>[m6]</h1><p>[m40]</p><p>[m30]</p></article></body>",
    "<body><nav><a href=/>[n1]</a> <a href=/b>[n2]</a></nav><article><p>[m50]</p></article><footer>[n8]</footer></body>",
    "<header><h1>[n3]</h1></header><main><h2>[m5]</h2><p>[m35]</p><p>[m28]</p></main><footer><p>[n9]</p></footer>",
    "<main><article><h1>[m5]</h1><p>[m22]</p><p>[m41]</p></article></main><aside><p>[n12]</p></aside>",
    "<body><header>[n4]</header><main><section><h2>[m4]</h2><p>[m33]</p></section><section><h2>[m4]</h2><p>[m25]</p></section></main></body>",
    "<article><h1>[m7]</h1><p>[m18]<p>[m26]<p>[m31]</article><footer>[n6]",
    "<nav><ul><li><a>[n1]</a><li><a>[n1]</a><li><a>[n2]</a></ul></nav><article><p>[m60]</p><p>[m44]</p></article>",
    # menus, headers and footers around
    "<div class=menu><ul><li><a>[n2]</a></li><li><a>[n1]</a></li></ul></div><article><p>[m45]</p><p>[m20]</p></article>",
    "<div class='header'><p>[n5]</p></div><main><p>[m30]</p><p>[m30]</p></main><div class='footer'><p>[n12]</p></div>",
    "<header><nav><a>[n1]</a><a>[n1]</a></nav><form><input><button>[n1]</button></form></header><article><p>[m50]</p></article>",
    "<nav role=navigation><a>[n2]</a></nav><article><h1>[m6]</h1><p>[m38]</p></article><nav><a>[n2]</a><a>[n2]</a></nav>",
    "<body><div id=header><h1>[n2]</h1></div><article><p>[m42]</p></article><div id=footer>[n10]</div></body>",
    "<div class='breadcrumb'><li><a>[n1]</a></li><li><a>[n2]</a></li></div><article><h1>[m5]</h1><p>[m30]</p></article>",
    "<article><p>[m30]</p></article><footer><ul><li><a>[n2]</a></li><li><a>[n2]</a></li><li><a>[n2]</a></li></ul><p>[n7]</p></footer>",
    # sidebars, related, social
    "<article><p>[m48]</p><p>[m29]</p></article><aside class=sidebar><div class=widget><ul><li><a>[n3]</a></li><li><a>[n2]</a></li></ul></div></aside>",
    "<div class=sidebar><p>[n14]</p><p>[n9]</p></div><article><p>[m36]</p><p>[m36]</p></article>",
    "<article><h1>[m4]</h1><p>[m52]</p><div class='share social'><ul><li><a>[n1]</a></li><li><a>[n1]</a></li></ul></div></article>",
    "<article><p>[m40]</p></article><div class=related><h3>[n2]</h3><ul><li><a>[n5]</a></li><li><a>[n6]</a></li></ul></div>",
    "<main><p>[m33]</p><aside><p>[n15]</p></aside><p>[m27]</p></main>",
    "<article><p>[m25]</p><aside class='pullquote'><p>[n10]</p></aside><p>[m35]</p></article>",
    "<article><p>[m44]</p></article><section class=related><h2>[n2]</h2><a>[n6]</a><a>[n5]</a></section>",
    # adverts, notices, consent
    "<div class='cookie notice'><p>[n15]</p></div><article><p>[m45]</p><p>[m20]</p></article>",
    "<article><p>[m30]</p><div class=ad>[n10]</div><p>[m30]</p></article>",
    "<div class='ads'><p>[n8]</p></div><main><article><p>[m50]</p></article></main><div class=ad>[n12]</div>",
    "<div class='banner promo'><p>[n10]</p></div><article><h1>[m6]</h1><p>[m28]</p></article>",
    "<article><p>[m37]</p><div class='sponsored'><p>[n14]</p></div><p>[m22]</p></article>",
    "<div class='alert message'><p>[n9]</p></div><main><p>[m41]</p></main>",
    "<article><p>[m26]</p></article><div class='newsletter'><p>[n11]</p><form><label>[n2]</label><button>[n1]</button></form></div>",
    "<div class='popup modal'><p>[n13]</p></div><article><p>[m36]</p><p>[m19]</p></article>",
    # forms
    "<form class=search><label>[n1]</label><input><button>[n1]</button></form><article><p>[m33]</p></article>",
    "<article><p>[m40]</p><form><fieldset><legend>[n2]</legend><label>[n3]</label></fieldset></form></article>",
    "<main><p>[m29]</p><form><select><option>[n1]</option><option>[n1]</option></select><textarea>[n2]</textarea></form><p>[m31]</p></main>",
    # comments of readers
    "<article><p>[m45]</p><p>[m33]</p></article><section class=comments><div class=comment><p>[n18]</p></div><div class=comment><p>[n25]</p></div></section>",
    "<article><h1>[m5]</h1><p>[m55]</p></article><div id=comments><h3>[n2]</h3><ol><li class=comment><p>[n30]</p></li><li class=comment><p>[n12]</p></li></ol></div>",
    "<main><article><p>[m50]</p><section class=comments><article class=comment><p>[n22]</p></article></section></article></main>",
    "<article><p>[m31]</p></article><ol class=commentlist><li class=comment><p>[n20]</p><div class=reply><p>[n8]</p></div></li></ol>",
    # lists, tables, quotes, figures inside the article
    "<article><p>[m20]</p><ul><li>[m5]</li><li>[m6]</li><li>[m4]</li></ul><p>[m30]</p></article><footer>[n5]</footer>",
    "<article><p>[m22]</p><ol><li>[m8]</li><li>[m7]</li></ol><p>[m18]</p></article><nav><a>[n2]</a></nav>",
    "<article><h1>[m4]</h1><table><tr><td>[m2]</td><td>[m3]</td></tr><tr><td>[m2]</td><td>[m4]</td></tr></table><p>[m35]</p></article>",
    "<article><p>[m28]</p><blockquote><p>[m24]</p></blockquote><p>[m30]</p></article><aside><p>[n10]</p></aside>",
    "<article><h2>[m4]</h2><p>[m24]</p><h3>[m3]</h3><p>[m26]</p><pre>[m12]</pre></article>",
    "<article><p>[m30]</p><figure><img src=x><figcaption>[m7]</figcaption></figure><p>[m22]</p></article><footer><p>[n6]</p></footer>",
    "<header>[n3]</header><article><h1>[m6]</h1><p><b>[m5]</b> [m20] <a href=x>[m2]</a> [m12]</p><p>[m28]</p></article>",
    # holders that are no article element
    "<nav><a>[n1]</a></nav><div class=content><p>[m40]</p><p>[m35]</p></div><footer>[n6]</footer>",
    "<div class='header'>[n3]</div><div class='post body'><h2>[m5]</h2><p>[m44]</p></div><div class=sidebar><p>[n11]</p></div>",
    "<div class=container><nav><li><a>[n1]</a></li></nav><div class='main content'><p>[m50]</p><p>[m22]</p></div></div>",
    "<article class=post><div class='entry content'><p>[m36]</p><p>[m30]</p></div><div class='tags'><li><a>[n1]</a></li></div></article>",
    "<div class=wrapper><header><p>[n4]</p></header><section class=article><p>[m38]</p><p>[m27]</p></section><footer>[n8]</footer></div>",
    # broken or unusual markup
    "<article><p>[m30]<!--><p>[m25]<!-- [n6] --></article><footer>[n4]</footer>",
    "<article><div><p>[m28]</p><div><p>[m22]</div></article><footer><p>[n5]",
    "<ARTICLE><P>[m35]</P><P>[m24]</P></ARTICLE><FOOTER>[n7]</FOOTER>",
    "<script>[n9]</script><style>[n5]</style><article><p>[m33]</p><noscript>[n4]</noscript><p>[m20]</p></article>",
    "<article><p>[m26]<br>[m14]<br/>[m10]</p></article><div class='copyright'>[n6]</div>",
    "<body><main><div><div><div><p>[m31]</p></div></div><p>[m29]</p></div></main><div class=disclaimer><p>[n16]</p></div></body>",
]
