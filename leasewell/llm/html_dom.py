"""A tolerant HTML reader for one page at a time: elements in page order with what their features need.

Only what a reader sees counts as text: the contents of scripts, styles, heads, templates and form controls are
skipped, comments and tags are markup.  Missing and stray end tags are repaired in the usual ways (a block ends an
open paragraph, an item ends an item, an end tag closes what is open inside it or is ignored).

The time is linear in the length of the page, whatever is in it: a tag is only looked for where a ``>`` follows, and the
places of open elements are kept by name, so that no end tag or repair walks the stack.
"""

from __future__ import annotations

import html
import re

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
SKIPPED = frozenset("head template svg select option optgroup datalist button object canvas audio video map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_ITSELF = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Tag groups of the features, by place in a one-hot vector.
TAG_GROUPS = [("nav",), ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset", "label", "legend"), ("article", "main"), ("section",), ("div", "center"), ("span",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th"), ("blockquote", "pre"), ("figure", "figcaption"), ("a",), ("dialog", "details", "summary")]
GROUP_OF_TAG = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags}

#: Words in class, id, role and itemprop attributes, by what they announce; a trailing * takes any ending.
TOKEN_GROUPS = [
    "nav navbar navigation menu* breadcrumb* crumb* tabs pager pagination skip toc topbar toolbar",
    "ad ads adv advert* adsense adslot sponsor* promo* banner* doubleclick dfp outbrain taboola commercial",
    "cookie* consent gdpr notice* alert* popup* modal overlay newsletter* subscri* paywall signup toast privacy disclaimer message",
    "comment* reply replies respond disqus discussion feedback review reviews guestbook reader readers reaction*",
    "sidebar side aside widget* related recommend* rail complementary secondary trending popular share sharing social more tags links",
    "footer foot bottom copyright contentinfo colophon legal credits",
    "header head masthead top site logo brand branding hero tagline",
    "form login search* contact register input field",
    "article* content main post entry story text body prose blog page news maincontent articlebody",
]
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
#: What boilerplate says, by kind; a trailing * takes any ending.
CUE_GROUPS = [
    "comment* reply replies respond discussion wrote says said likes",
    "copyright © rights reserved imprint",
    "cookie* consent accept privacy terms gdpr",
    "advertisement sponsored promoted advert offer discount sale deal",
    "subscribe newsletter sign login log register password search email username submit",
    "related popular trending recommended latest share follow tags archive",
    "home about contact menu next previous help sitemap",
]
_CUE = re.compile("|".join(f"({'|'.join(w[:-1] + r'[a-z]*' if w[-1] == '*' else w for w in words.split())})" for words in CUE_GROUPS).join((r"(?<![a-z])(?:", r")(?![a-z])")))
#: A name before what it says: how readers' comments often begin.
_SPEAKER = re.compile(r"\s*@?\w+(?: \w+)?(?:, [\w :]+)?(?:: | says| wrote| said)")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_exact = {w: k for k, words in enumerate(TOKEN_GROUPS) for w in words.split() if w[-1] != "*"}
_starts = [(w[:-1], k) for k, words in enumerate(TOKEN_GROUPS) for w in words.split() if w[-1] == "*"]
_known: dict[str, int] = {}


def token_groups(attributes: str) -> int:
    """Bit mask of the token groups that an element's attributes name."""
    mask = 0
    for found in _ATTRIBUTE.findall(attributes):
        value = found[0] or found[1] or found[2]
        if value not in _known:
            if len(_known) > 100_000:
                _known.clear()
            own = 0
            for word in _CAMEL.findall(value):
                word = word.lower()
                if word in _exact:
                    own |= 1 << _exact[word]
                else:
                    for start, k in _starts:
                        if word.startswith(start):
                            own |= 1 << k
            _known[value] = own
        mask |= _known[value]
    return mask


class Page:
    """Elements of a page in page order; element 0 is the page itself."""

    def __init__(self, source: str, marker: str = ""):
        self.marker, self.marked = marker, []
        self.parent, self.end, self.depth = [-1], [0], [0]
        self.tag, self.tokens, self.above, self.above_tags = [-1], [0], [0], [0]
        self.chars, self.linked, self.marks, self.controls, self.breaks = [0], [0], [0], [0], [0]
        self.cues, self.speakers, self.digits = [0], [0], [0]
        self.index, self.children, self.before, self.youngest = [0], [0], [-1], [-1]
        self.text: list[tuple[int, str]] = []
        #: open elements: tag, element, block, skipped, link; the places of those of each name, and of blocks
        self._open: list[tuple[str, int, bool, bool, bool]] = [("", 0, True, False, False)]
        self._places: dict[str, list[int]] = {}
        self._blocks = [0]
        at, n, last = 0, len(source), source.rfind(">")
        while at < n:
            stop, end, found = source.find("<", at), n, None
            while stop >= 0:
                if source.startswith("<!--", stop):
                    end = source.find("-->", stop + 4) + 3
                    end = end if end > 2 else n
                    break
                if stop < last and (found := _TAG.match(source, stop)):
                    end = found.end()
                    break
                stop = source.find("<", stop + 1)
            if stop != at:
                self._characters(source[at:stop] if stop >= 0 else source[at:], stop < 0)
            at = end
            name = (found[2] or found[5]) if found else None
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._end_tag(name)
            else:
                self._start_tag(name, found[3] or found[6] or "")
                if name in RAW:
                    close = _RAW_END[name].search(source, at)
                    at = source.find(">", close.end()) + 1 if close else 0
                    at = at or n
                    self._end_tag(name)
        while self._open:
            self._pop()

    def _characters(self, raw: str, last: bool) -> None:
        tag, element, _, skipped, link = self._open[-1]
        if skipped:
            return
        if last:
            raw = re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", raw)
        text = html.unescape(raw) if "&" in raw else raw
        self.text.append((element, text))
        size = len(text) - text.count(" ")
        self.chars[element] += size
        self.linked[element] += size * link
        self.marks[element] += text.count(".") + text.count(",")
        for found in _CUE.finditer(text.lower()):
            self.cues[element] |= 1 << (found.lastindex - 1)
        self.speakers[element] += _SPEAKER.match(text) is not None
        self.digits[element] += any(c.isdigit() for c in text[:40])

    def _start_tag(self, name: str, attributes: str) -> None:
        opened = self._open
        if name in VOID:
            element = opened[-1][1]
            if name in ("br", "hr"):
                self.text.append((element, " "))
                self.breaks[element] += 1
            elif name == "input":
                self.controls[element] += 1
            return
        if name in BLOCK:
            if name in ("html", "body") and self._places.get(name):
                return
            if name == "body" or opened[-1][0] == "head":
                self._close_until({"head"}, set())
            self._close_until({"p"}, {"td", "th", "table", "button", "caption"})
        if name in ENDS_ITSELF:
            self._close_until(*ENDS_ITSELF[name])
        tag, above, block, skipped, link = opened[-1]
        own_tokens = token_groups(attributes) if attributes else 0
        element = above
        if name in ("button", "select", "textarea"):
            self.controls[above] += 1
        if name in BLOCK or own_tokens or name == "label":
            element = len(self.parent)
            group = GROUP_OF_TAG.get(name, -1)
            self.parent.append(above)
            self.end.append(0)
            self.depth.append(self.depth[above] + 1)
            self.tag.append(group)
            self.tokens.append(own_tokens)
            self.above.append(self.above[above] | self.tokens[above])
            self.above_tags.append(self.above_tags[above] | (1 << self.tag[above] if self.tag[above] >= 0 else 0))
            self.index.append(self.children[above])
            self.children[above] += 1
            self.before.append(self.youngest[above])
            self.youngest[above] = element
            self.youngest.append(-1)
            for values in (self.chars, self.linked, self.marks, self.controls, self.breaks, self.children, self.cues, self.speakers, self.digits):
                values.append(0)
        if self.marker and self.marker in attributes:
            self.marked.append(element)
        if name in BLOCK:
            self.text.append((element, " "))
        self._places.setdefault(name, []).append(len(opened))
        if name in BLOCK:
            self._blocks.append(len(opened))
        opened.append((name, element, name in BLOCK, skipped or name in SKIPPED or name in RAW, link or name == "a"))

    def _top(self, names: set[str]) -> int:
        """The place of the innermost open element with one of these names, -1 if there is none."""
        return max((found[-1] for name in names if (found := self._places.get(name))), default=-1)

    def _end_tag(self, name: str) -> None:
        place = self._top({name})
        if place < 0 or (name not in BLOCK and self._blocks[-1] > place):
            return
        while len(self._open) > place:
            self._pop()

    def _close_until(self, names: set[str], barriers: set[str]) -> None:
        opened, place = self._open, self._top(names)
        if place < 0 or self._top(barriers) > place:
            return
        while place > 1 and opened[place - 1][0] in names:
            place -= 1
        while len(opened) > place:
            self._pop()

    def _pop(self) -> None:
        name, element, block, _, _ = self._open.pop()
        if self._open:
            self._places[name].pop()
            if block:
                self._blocks.pop()
        if block:
            self.text.append((element, " "))
        if not self._open or self._open[-1][1] != element:
            self.end[element] = len(self.parent)

    def kept_text(self, keep: list[bool]) -> str:
        """The text of the kept elements: white space as single spaces, blocks apart by one."""
        return " ".join("".join([text for element, text in self.text if text == " " or keep[element]]).split())
