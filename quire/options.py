"""Choices a caller makes before anything is read: content kinds, detail level, limits."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

TEXT, GRAPHICS, IMAGES, ANNOTATIONS = 1, 2, 4, 8
ALL = TEXT | GRAPHICS | IMAGES | ANNOTATIONS
BASIC, LAYOUT, FULL = 0, 1, 2
_KINDS = {"text": TEXT, "graphics": GRAPHICS, "images": IMAGES, "annotations": ANNOTATIONS, "all": ALL}
_LEVELS = {"basic": BASIC, "layout": LAYOUT, "full": FULL}


@dataclass(frozen=True)
class Limits:
    """Zero means the default; a negative value is refused."""

    max_file_bytes: int = 256 << 20
    buffer_size: int = 64 << 10
    max_depth: int = 256
    max_token_bytes: int = 16 << 20
    max_objects: int = 1_000_000
    max_xref_sections: int = 256
    max_decoded_bytes: int = 256 << 20
    max_values: int = 1 << 20
    max_content_bytes: int = 256 << 20
    max_semantic_objects: int = 0
    max_region_work: int = 16 << 20

    def checked(self) -> "Limits":
        if "_ok" in self.__dict__:  # asked of each document anew
            return self
        out = self
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, int) or value < 0:
                raise ValueError(f"{f.name} must not be negative: {value!r}")
            if value == 0:
                out = replace(out, **{f.name: f.default or out.max_objects})
        out = replace(out)
        object.__setattr__(out, "_ok", True)
        return out


@dataclass(frozen=True)
class ParseOptions:
    content: int = TEXT
    detail: int = BASIC
    limits: Limits = Limits()
    #: Texts of glyph names beyond the built-in ones (kernel.glyphs.read_glyph_list).
    glyphs: dict[str, str] | None = None

    def checked(self) -> "ParseOptions":
        """Options with defaults filled in; raises ValueError before any input is touched."""
        content, detail = self.content or TEXT, self.detail
        if isinstance(content, str):
            try:
                content = sum({_KINDS[k.strip().lower()] for k in content.split(",") if k.strip()}) if content != "all" else ALL
            except KeyError as e:
                raise ValueError(f"unknown content kind: {e}") from None
            content = content or TEXT
        if isinstance(detail, str):
            if detail.lower() not in _LEVELS:
                raise ValueError(f"unknown detail level: {detail}")
            detail = _LEVELS[detail.lower()]
        if not isinstance(content, int) or content & ~ALL or content < 0:
            raise ValueError(f"unknown content kinds: {content!r}")
        if detail not in (BASIC, LAYOUT, FULL):
            raise ValueError(f"unknown detail level: {detail!r}")
        return ParseOptions(content, detail, self.limits.checked(), self.glyphs)
