"""Parameters of a catalogue analysis."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    """Thresholds and switches; ``checked`` raises ValueError on values out of range."""

    sample: int = 16
    margin: float = 0.05
    auto: float = 0.85
    review: float = 0.65
    accept_review: bool = False
    sequence: bool = True  # score by the sequence ratio too; without it scores are built-in expressions only
    approved: frozenset = field(default_factory=frozenset)  # unordered pairs of relative paths
    aliases: dict = field(default_factory=dict)  # variant series key -> canonical series key
    retry_overflow: bool = True
    verify_content: bool = False
    hash_distance: int = 6
    delete_losers: bool = False
    language: str = "ja"
    fallback_series: str = ""
    duplicates_folder: str | None = None
    wrap_format: str = "rar"
    rar_level: int = 3
    recovery_percent: int = 5

    def checked(self) -> Options:
        rules = (
            (self.sample >= 1, "sample must be at least 1"),
            (0 <= self.margin < 1, "margin must be in [0, 1)"),
            (0 < self.auto <= 1, "auto must be in (0, 1]"),
            (0 < self.review <= self.auto, "review must be in (0, auto]"),
            (self.language in FOLDERS, "language must be ja or en"),
            (self.wrap_format in ("rar", "zip"), "wrap_format must be rar or zip"),
            (0 <= self.rar_level <= 5, "rar_level must be in 0..5"),
            (0 <= self.recovery_percent <= 10, "recovery_percent must be in 0..10"),
        )
        if bad := [text for ok, text in rules if not ok]:
            raise ValueError("; ".join(bad))
        return self

    @property
    def folders(self) -> dict:
        names = FOLDERS[self.language]
        return names | {"duplicates": self.duplicates_folder} if self.duplicates_folder else names


# Folder names and name templates by language.
FOLDERS = {
    "ja": {"duplicates": "_重複", "excluded": "_除外", "held": "_保留", "others": "_その他", "volume": "%s 第%s巻", "volume_only": "第%s巻"},
    "en": {"duplicates": "_duplicates", "excluded": "_excluded", "held": "_held", "others": "_others", "volume": "%s Vol %s", "volume_only": "Vol %s"},
}
CHAPTER, CHAPTER_ONLY = "%s ch%s", "ch%s"
