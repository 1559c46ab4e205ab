"""A parser of HTML that reads any text to its end, in time linear in its length."""

from __future__ import annotations

from html.parser import HTMLParser


class TolerantParser(HTMLParser):
    """The standard library's events for a whole page given in one :meth:`read`.

    Broken markup is read as browsers do: ``<![...]>`` is a comment, and a comment,
    declaration or tag that never ends reaches to the end of the page and is no text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.in_tag = False

    def read(self, html: str) -> None:
        self.feed(html)
        self.close()

    def handle_data(self, data: str) -> None:
        if not self.in_tag:
            self.handle_text(data)

    def handle_text(self, data: str) -> None:
        """Text between tags."""

    def _or_end(self, at: int) -> int:
        return len(self.rawdata) if at < 0 else at

    def parse_starttag(self, i: int) -> int:
        # what is no proper tag would be handed out as text
        self.in_tag = True
        try:
            return self._or_end(super().parse_starttag(i))
        finally:
            self.in_tag = False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def parse_endtag(self, i: int) -> int:
        return self._or_end(super().parse_endtag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i) + 1
        end = self.rawdata.find("-->", i + 4)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return self._or_end(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![CDATA[", i) and (end := self.rawdata.find("]]>", i)) >= 0:
            return end + 3
        if self.rawdata.startswith("<![", i):
            return self._or_end(self.parse_bogus_comment(i))
        return self._or_end(super().parse_html_declaration(i))
