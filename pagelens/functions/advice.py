"""What each finding says: a heading, and what to do about it."""

from __future__ import annotations

ADVICE = {
    "http.unreachable": ("Page can't be loaded", "Nothing answered at this address. Check DNS, certificate, firewall and whether the server is up; nothing else about the page was judged."),
    "http.server_error": ("Server error", "The server fails while it builds the page. Look at its error log for this address; search engines drop pages that keep failing."),
    "http.404_in_sitemap": ("Sitemap lists a missing page", "Take the address out of the sitemap, or bring the page back, or redirect it to the page that replaced it."),
    "http.client_error": ("Page answers with an error", "Mend the page, or remove the links that lead to it; visitors and robots find nothing here."),
    "http.redirect_chain": ("Long chain of redirects", "Point links and the first redirect straight at the final address; every hop costs time and robots stop following long chains."),
    "sitemap.redirecting_url": ("Sitemap lists a redirect", "Put the final address into the sitemap in place of the one that redirects."),
    "security.no_https": ("Page is served without HTTPS", "Redirect http to https for the whole site and correct the addresses in templates, sitemap and canonical tags."),
    "canonical.missing": ("No canonical address", "Add one canonical link with the page's own full address, so that copies with parameters count for it."),
    "canonical.duplicate_tag": ("Several canonical tags", "Leave a single canonical tag; with several, search engines ignore them all. A theme and a plug-in often both write one."),
    "canonical.cross_host": ("Canonical points to another site", "The page gives its place in search results away. Set the canonical to an address of this site unless the copy is meant."),
    "canonical.cross_language": ("Canonical points to another language", "Every language version needs itself as canonical; tie the versions together with hreflang instead."),
    "canonical.points_elsewhere": ("Canonical points to another page", "Make sure that this page really is a copy of the other one; otherwise set its own address as canonical."),
    "robots.noindex_in_sitemap": ("Sitemap lists a page closed to indexing", "The sitemap asks for indexing and the page forbids it. Remove noindex or take the address out of the sitemap."),
    "robots.noindex": ("Page is closed to indexing", "Nothing to do if that is meant; otherwise remove noindex from the robots tag."),
    "title.duplicate_tag": ("Several title tags", "Leave one title element in the head; look for templates that add a second one, and for titles of inline graphics."),
    "title.missing": ("No title", "Write a title that says what the page offers; search results show it as the link."),
    "title.too_short": ("Title is short", "Say more about the page: what, where and for whom; short titles waste room in the results."),
    "title.too_long": ("Title is long", "Shorten the title so that results show it whole; put what matters first."),
    "description.duplicate_tag": ("Several description tags", "Leave one description tag; which of several is shown is left to chance."),
    "description.missing": ("No description", "Write one or two sentences on what the visitor gets; without them results show a random piece of text."),
    "description.too_short": ("Description is short", "Use the room for a reason to open the page."),
    "description.too_long": ("Description is long", "Shorten the description so that its end isn't cut off in the results."),
    "h1.missing": ("No main heading", "Give the page one h1 that names its subject."),
    "h1.multiple": ("Several main headings", "Keep one h1 and turn the others into h2; logos and banners often carry a needless one."),
    "content.thin": ("Little text", "Add what visitors come for, or merge the page with a fuller one, or close it to indexing."),
    "images.missing_alt": ("Images without description", "Write alt texts for images that mean something; leave the attribute empty only for decoration."),
    "performance.very_slow": ("Very slow answer", "Measure where the time goes: database, plug-ins, missing cache; visitors leave before such a page opens."),
    "performance.slow": ("Slow answer", "Turn on caching and check heavy plug-ins and queries; robots fetch fewer pages from slow sites."),
    "i18n.lang_missing": ("Language isn't declared", "Set the lang attribute of the html element; browsers and screen readers rely on it."),
    "i18n.title_language_mismatch": ("Title is in another language than the page", "Translate the title; a language plug-in probably took that of another version."),
    "i18n.description_language_mismatch": ("Description is in another language than the page", "Translate the description; a language plug-in probably took that of another version."),
    "i18n.hreflang_no_self": ("Language links leave out the page itself", "Every version has to list all versions, itself included, or the links don't count."),
    "i18n.hreflang_lang_absent": ("Language links leave out the page's language", "Add a link for the language that the html element declares, or correct the declaration."),
    "robots.conflicting": ("Robots tags contradict each other", "One tag allows indexing and another forbids it, and the strictest counts. Leave one tag that says what is meant."),
    "robots.duplicate_tag": ("Several robots tags", "Leave one robots tag; find the template or plug-in that adds the other."),
    "mobile.viewport_missing": ("No viewport for phones", "Add a viewport tag with width=device-width, or phones show the page as a tiny desktop."),
    "mobile.zoom_blocked": ("Zoom is forbidden", "Remove user-scalable=no and maximum-scale=1; people with weak sight need to zoom."),
    "encoding.charset_missing": ("Character encoding isn't declared", "Declare utf-8 in the head or in the Content-Type header, or letters may show as garbage."),
    "structure.heading_skip": ("Heading levels are skipped", "Let headings go down one level at a time; choose sizes by style, not by level."),
    "schema.missing": ("No structured data", "Describe the page with JSON-LD (organisation, article, product), so that results can show more than a link."),
    "schema.no_organization": ("Home page doesn't describe the organisation", "Add JSON-LD of type Organization or LocalBusiness with name, address and contact."),
    "social.og_missing": ("No preview for social networks", "Add og:title, og:description and og:image; shared links look bare without them."),
    "social.og_image_missing": ("No preview image", "Add og:image with a full address of a picture of 1200 by 630 points or so."),
    "robots.txt_missing": ("No robots.txt", "Add the file, if only to name the sitemap; without it robots guess."),
    "sitemap.missing": ("No sitemap", "Have the site write a sitemap and name it in robots.txt; new pages are found late without one."),
    "sitemap.not_in_robots": ("robots.txt doesn't name the sitemap", "Add a Sitemap line with the sitemap's full address."),
    "sitemap.section_absent": ("A whole section is missing from the sitemap", "Include this kind of page in the sitemap's settings; none of the section's pages is listed."),
    "duplicate.title": ("Pages share a title", "Give each page a title of its own; pages with one title compete with each other."),
    "duplicate.description": ("Pages share a description", "Write a description for each page, or leave it out where there is nothing special to say."),
    "canonical.mass_collapse": ("Many pages give one other page as canonical", "All these pages drop out of search in favour of one. Check the template's canonical."),
    "cache.serving_stale": ("Cache serves old pages", "Visitors and robots get an old version. Clear the cache, and have it cleared when pages change."),
    "cache.fully_cached": ("Every page comes from a cache", "Nothing is wrong, but changes show only when the cache is cleared; keep that in mind when checking fixes."),
    "security.mixed_scheme": ("Some pages are served by http, others by https", "Move the rest to https and redirect; two addresses of one page split its weight."),
    "structure.orphan_suspect": ("Hardly any page is linked", "Most likely the menu is drawn by scripts and wasn't seen; check that links are in the HTML itself."),
    "structure.orphan_page": ("Pages that no page links to", "Link to these pages from menus, lists or texts; robots reach them by the sitemap only and rank them low."),
    "structure.broken_internal_link": ("Links to pages that don't work", "Correct or remove the links; the list tells which pages hold them."),
    "structure.deep_page": ("Pages far from the home page", "Shorten the way with lists, menus or related links; pages many clicks away are visited rarely."),
    "structure.dead_end": ("Pages without a link onwards", "Add navigation or related links, so that visitors and robots can go on."),
}
