"""Key-domain sizes and thresholds of one imaging run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ImagingConfig:
    """Sizes of the key dimensions.

    Every derived stage below the measurement level has at most
    ``product(its key dimensions)`` rows, whatever the size of the input
    tables; the ``max_*`` properties are those bounds and decide which
    tables may be broadcast.
    """

    facets: int = 49
    channels: int = 20
    coarse_channels: int = 5
    polarisations: int = 4
    slots: int = 8
    cells: int = 16
    antennas: int = 16
    # Gridding kernels: planes that they widen with, and places inside a cell along each axis.
    w_planes: int = 4
    sub_cells: int = 2
    peak_threshold: int = 1000
    # Minor cycles: share of a peak taken at once, share of the first peak at which to stop, both in percent.
    minor_gain_percent: int = 10
    minor_stop_percent: int = 50
    minor_iterations: int = 100
    # A source's cells are above this share of the mean of their facet.
    island_percent: int = 150
    # Flags by runs: limit in median deviations, and how often the medians are taken anew.
    flag_factor: int = 6
    flag_rounds: int = 2
    # Cells between a source and the catalogue component that it is merged with.
    match_radius: int = 1
    start: str = "2024-01-01 00:00:00"
    window_seconds: int = 30 * 86_400

    def __post_init__(self) -> None:
        if self.channels % self.coarse_channels:
            raise ValueError("channels must be a multiple of coarse_channels")
        if self.window_seconds % self.slots:
            raise ValueError("window_seconds must be a multiple of slots")
        if 2 * self.match_radius + 1 > self.cells:
            raise ValueError("match_radius must be under half of cells")

    @property
    def refinement(self) -> int:
        """Fine channels per coarse channel."""
        return self.channels // self.coarse_channels

    @property
    def slot_seconds(self) -> int:
        return self.window_seconds // self.slots

    @property
    def antenna_pairs(self) -> int:
        return self.antennas * (self.antennas - 1) // 2

    @property
    def max_images(self) -> int:
        return self.facets * self.polarisations

    @property
    def max_cells(self) -> int:
        return self.max_images * self.cells * self.cells


# The three published domain layouts: facets 7x7 or 9x9, and 8, 120 or 12 slots.
NARROW_SNAPSHOT = ImagingConfig()
WIDE_FACETS = ImagingConfig(facets=81, slots=120)
WIDE_FACETS_TWELVE_SLOTS = ImagingConfig(facets=81, slots=12)
