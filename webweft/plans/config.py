"""Settings of a crawl: profiles, which explicit settings override, and their validation."""

from __future__ import annotations

from dataclasses import dataclass

NAMES = ("depth", "concurrency", "wait_ms", "timeout_ms", "max_renders", "interaction_steps", "idle_ms", "storm_threshold", "ajax_max_pages")
#: The profiles' settings in the order of NAMES. Balanced has the defaults.
PROFILES = {
    "balanced": (),
    "fast": (2, 24, 2500, 20000, 2, 3, 300, 3, 25),
    "deep": (5, 12, 6500, 35000, 0, 10, 800, 5, 150),
    "dynamic-heavy": (3, 10, 7000, 45000, 0, 12, 900, 6, 300),
}
RENDER_MODES = ("auto", "static", "dynamic")
POSITIVE = ("concurrency", "request_timeout", "max_bytes", "timeout_ms")


@dataclass(frozen=True)
class CrawlConfig:
    url: str
    output: str
    depth: int = 2
    concurrency: int = 16
    requests_per_second: float = 0.0
    request_timeout: int = 30
    max_bytes: int = 52_428_800
    wait_ms: int = 5000
    timeout_ms: int = 30000
    max_renders: int = 0
    interaction_steps: int = 8
    idle_ms: int = 700
    storm_threshold: int = 4
    ajax_max_pages: int = 50
    probing: bool = False
    render_mode: str = "auto"
    headers: tuple[str, ...] = ()
    cookies: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("url", "output"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} must not be empty")
        for name in POSITIVE:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than 0")
        for name in ({*NAMES, "requests_per_second"}).difference(POSITIVE):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name, sign in (("headers", ":"), ("cookies", "=")):
            if bad := [x for x in getattr(self, name) if sign not in x]:
                raise ValueError(f"{name} without {sign}: {bad[0]}")
        object.__setattr__(self, "render_mode", self.render_mode.strip().lower())
        if self.render_mode not in RENDER_MODES:
            raise ValueError(f"no such render mode: {self.render_mode}")

    @classmethod
    def from_profile(cls, profile: str, **explicit) -> CrawlConfig:
        name = profile.strip().lower() or "balanced"
        if name not in PROFILES:
            raise ValueError(f"no such profile: {profile}")
        preset = dict(zip(NAMES, PROFILES[name], strict=False))
        if name in ("deep", "dynamic-heavy"):
            preset["probing"] = True
        if name == "dynamic-heavy":
            preset["render_mode"] = "dynamic"
        return cls(**(preset | explicit))
