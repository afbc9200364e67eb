"""Interpretation of a page's content streams: glyphs, rectangles, segments and places of images, in page space."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from folio.operators.geometry import concatenated, transformed
from folio.sources.pdf.fonts import Decoder, Fonts
from folio.sources.pdf.objects import Document, Lexer, Operator, Page, PdfError, Ref, Stream

# States that can be kept, forms inside forms, width of a character that has none, and the share of the
# font's size from which a shift to the right is a space.
STATES, FORMS, NO_WIDTH, SPACE = 256, 4, 0.5, 0.1
IDENTITY = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


@dataclass
class Graphics:
    matrix: list = field(default_factory=lambda: [*IDENTITY])
    clipped: bool = False

    def copy(self) -> Graphics:
        return Graphics([*self.matrix], self.clipped)


@dataclass
class Text:
    font: str = ""
    size: float = 0.0
    matrix: list = field(default_factory=lambda: [*IDENTITY])
    line: list = field(default_factory=lambda: [*IDENTITY])
    leading: float = 0.0
    scale: float = 1.0

    def move(self, x: float, y: float) -> None:
        self.line[4:] = transformed(x, y, self.line)
        self.matrix = [*self.line]

    def next_line(self) -> None:
        self.move(0.0, -self.leading)

    def advance(self, x: float) -> None:
        self.matrix[4] += self.matrix[0] * x
        self.matrix[5] += self.matrix[1] * x


@dataclass
class Form:
    """A stream that is drawn like a page's."""

    number: int
    content: bytes
    matrix: list | None
    fonts: dict[str, Decoder]
    forms: dict[str, Form]


class Resources:
    """Fonts, forms and images of a document's pages; each is read once."""

    def __init__(self, doc: Document):
        self.doc, self.fonts, self.known = doc, Fonts(doc), {}

    def objects(self, resources: dict, kind: str) -> dict[str, Stream]:
        items = ((name, self.doc.get(ref)) for name, ref in self.doc.dict(resources.get("XObject")).items() if isinstance(ref, Ref))
        return {name: x for name, x in items if isinstance(x, Stream) and self.doc.get(x.props.get("Subtype")) == kind}

    def images(self, resources: dict) -> dict[str, int]:
        return {name: x.number for name, x in self.objects(resources, "Image").items()}

    def forms(self, resources: dict, depth: int = 0, path: frozenset = frozenset()) -> dict[str, Form]:
        out = {}
        for name, x in self.objects(resources, "Form").items() if depth <= FORMS else ():
            if x.number in path:
                continue
            if (x.number, depth) not in self.known:
                inner = self.doc.dict(x.props.get("Resources"))
                numbers = [self.doc.get(v) for v in self.doc.array(x.props.get("Matrix"))]
                try:
                    content = self.doc.decoded(x)
                except (PdfError, ValueError):
                    continue
                matrix = [float(v) for v in numbers] if len(numbers) == 6 and all(isinstance(v, (int, float)) for v in numbers) else None
                self.known[x.number, depth] = Form(x.number, content, matrix, self.fonts.of(inner), self.forms(inner, depth + 1, path | {x.number}))
            out[name] = self.known[x.number, depth]
        return out


class Interpreter:
    """Follows the operators of a page; what it finds is in glyphs, rects, segments and placements."""

    def __init__(self, fonts: dict[str, Decoder], forms: dict[str, Form], images: dict[str, int]):
        self.fonts, self.forms, self.images = fonts, forms, images
        self.glyphs: list[dict] = []
        self.rects: list[tuple] = []
        self.segments: list[tuple] = []
        self.placements: list[tuple] = []
        self.state, self.kept, self.text = Graphics(), [], Text()
        self.path: list[tuple] = []
        self.form, self.inside = 0, []

    def run(self, content: bytes) -> None:
        """Up to the end, or to the first token that can't be read."""
        lexer, operands = Lexer(content, bare=True), []
        while lexer.skip():
            if content.startswith((b"<<", b">>"), lexer.at):
                lexer.at += 2
                continue
            try:
                token = lexer.read()
            except PdfError:
                return
            if isinstance(token, Operator):
                self.apply(token, operands)
                operands = []
            else:
                operands.append(token)

    def apply(self, op: str, operands: list) -> None:
        method = ACTIONS.get(op)
        numbers = [v for v in operands if isinstance(v, float)]
        if method is None:
            return
        need, action = method
        if need is bytes:
            strings = [v for v in operands if isinstance(v, bytes)]
            action(self, operands, strings[-1] if strings else b"")
        elif len(numbers) >= need:
            action(self, operands, numbers)

    def point(self, x: float, y: float) -> tuple[float, float]:
        return transformed(x, y, self.state.matrix)

    def begin_text(self, *_: Any) -> None:
        self.text = Text(self.text.font, self.text.size)

    def set_font(self, operands: list, numbers: list) -> None:
        if isinstance(operands[0], str):
            self.text.font = str(operands[0])
        self.text.size = numbers[-1]

    def set_matrix(self, _: list, m: list) -> None:
        self.text.matrix, self.text.line = m[:6], m[:6]

    def move(self, _: list, v: list) -> None:
        self.text.move(v[0], v[1])

    def move_leading(self, _: list, v: list) -> None:
        self.text.leading = -v[1]
        self.text.move(v[0], v[1])

    def leading(self, _: list, v: list) -> None:
        self.text.leading = v[0]

    def scale(self, _: list, v: list) -> None:
        self.text.scale = v[0] / 100

    def next_line(self, *_: Any) -> None:
        self.text.next_line()

    def show(self, _: list, data: bytes) -> None:
        font = self.fonts.get(self.text.font)
        if font is None:
            return
        t, m, c = self.text, self.text.matrix, self.state.matrix
        wide, high = c[0] * m[0] + c[2] * m[1], c[1] * m[1] + c[3] * m[3]
        both = abs(wide) + abs(high) or 1.0
        em = t.size * t.scale
        for char, width in font.decode(data):
            shift = (width or NO_WIDTH) * em
            x, y = self.point(m[4], m[5])
            across = wide * shift if abs(wide * shift) >= 0.01 else both * shift
            height = abs(high) * em if abs(high) * em >= 0.01 else both * em
            self.glyph(char, x, y, (x, y - height * 0.2, x + across, y + height * 0.8), across, height, self.form, self.state.clipped)
            t.advance(shift)

    def glyph(self, text: str, x: float, y: float, box: tuple, advance: float, height: float, form: int, clipped: bool) -> None:
        sides = dict(zip(("x0", "y0", "x1", "y1"), box))
        self.glyphs.append({"seq_no": len(self.glyphs) + 1, "text": text, "ox": x, "oy": y, "bbox": sides, "font_name": self.text.font, "font_size": self.text.size, "advance": advance, "form_obj": form, "visual_size": height, "clipped": clipped})

    def next_line_show(self, operands: list, data: bytes) -> None:
        self.text.next_line()
        self.show(operands, data)

    def show_shifted(self, operands: list, _: Any) -> None:
        """Strings with shifts between them in thousandths; a wide shift to the right is a space without a box."""
        for part in (x for v in operands for x in (v if isinstance(v, list) else [v])):
            if isinstance(part, bytes):
                self.show(operands, part)
            elif isinstance(part, float) and any(isinstance(v, list) for v in operands):
                m, c = self.text.matrix, self.state.matrix
                before = self.point(m[4], m[5])
                self.text.advance(-part / 1000)
                gap, size = abs(self.point(m[4], m[5])[0] - before[0]), abs(c[0] * m[0] + c[2] * m[1])
                if part < 0 and size > 0 and gap > size * SPACE:
                    self.glyph(" ", *before, (0.0,) * 4, gap, size, 0, False)

    def keep(self, *_: Any) -> None:
        if len(self.kept) < STATES:
            self.kept.append(self.state.copy())

    def restore(self, *_: Any) -> None:
        if self.kept:
            self.state = self.kept.pop()

    def concat(self, _: list, m: list) -> None:
        self.state.matrix = concatenated(m[:6], self.state.matrix)

    def box(self, a: tuple, b: tuple) -> tuple:
        (x0, y0), (x1, y1) = self.point(*a), self.point(*b)
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    def rectangle(self, _: list, v: list) -> None:
        self.rects.append(self.box((v[0], v[1]), (v[0] + v[2], v[1] + v[3])))

    def start(self, _: list, v: list) -> None:
        self.path = [self.point(v[0], v[1])]

    def line_to(self, _: list, v: list) -> None:
        self.path.append(self.point(v[0], v[1]))

    def stroke(self, *_: Any) -> None:
        self.segments += [(*a, *b) for a, b in zip(self.path, self.path[1:])]
        self.path = []

    def drop_path(self, *_: Any) -> None:
        self.path = []

    def clip(self, *_: Any) -> None:
        self.state.clipped, self.path = True, []

    def draw(self, operands: list, _: list) -> None:
        name = str(operands[0]) if operands and isinstance(operands[0], str) else ""
        if name in self.forms:
            self.draw_form(self.forms[name])
        elif name in self.images:
            self.placements.append((name, self.images[name], self.box((0.0, 0.0), (1.0, 1.0))))

    def draw_form(self, form: Form) -> None:
        if form.number in self.inside:
            return
        outer = self.state.copy(), [*self.kept], self.text, self.fonts, self.forms, self.form
        self.inside.append(form.number)
        t = self.text
        self.text = Text(t.font, t.size, [*t.matrix], [*t.line], t.leading, t.scale)
        self.fonts, self.forms, self.form = {**self.fonts, **form.fonts}, {**self.forms, **form.forms}, form.number
        if form.matrix:
            self.state = Graphics(concatenated(form.matrix, self.state.matrix))
        self.run(form.content)
        self.inside.pop()
        self.state, self.kept, self.text, self.fonts, self.forms, self.form = outer


#: By operator: how many numbers it needs, or that it takes a string, and what it does. Operators that don't stand here
#: (colours, curves, spacing of characters, inline images) change nothing that is read.
ACTIONS = {
    "BT": (0, Interpreter.begin_text), "ET": (0, Interpreter.begin_text), "Tf": (1, Interpreter.set_font), "Tm": (6, Interpreter.set_matrix), "Td": (2, Interpreter.move), "TD": (2, Interpreter.move_leading),
    "T*": (0, Interpreter.next_line), "TL": (1, Interpreter.leading), "Tz": (1, Interpreter.scale), "Tj": (bytes, Interpreter.show), "TJ": (bytes, Interpreter.show_shifted), "'": (bytes, Interpreter.next_line_show), '"': (bytes, Interpreter.next_line_show),
    "q": (0, Interpreter.keep), "Q": (0, Interpreter.restore), "cm": (6, Interpreter.concat), "re": (4, Interpreter.rectangle), "m": (2, Interpreter.start), "l": (2, Interpreter.line_to), "S": (0, Interpreter.stroke),
    "f": (0, Interpreter.drop_path), "f*": (0, Interpreter.drop_path), "B": (0, Interpreter.drop_path), "n": (0, Interpreter.drop_path), "W": (0, Interpreter.clip), "W*": (0, Interpreter.clip), "Do": (0, Interpreter.draw),
}


def interpreted(resources: Resources, page: Page) -> Interpreter:
    found = Interpreter(resources.fonts.of(page.resources), resources.forms(page.resources), resources.images(page.resources))
    found.run(resources.doc.content(page))
    return found
