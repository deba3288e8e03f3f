"""Constants of the surveys and validated settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

# Flux units and zero points.
UJY_PER_NMGY = 3.631
ZP_NMGY = 22.5
ZP_UJY = 23.9
VEGA_AB = {"W1": 2.699, "W2": 3.339}
# Instrument scales and corrections.
UNWISE_SCALE, UNWISE_FWHM = 2.75, 6.94
IRAC_FLUX_CORRECTION = {"IRAC1": 0.943, "IRAC2": 0.929, "IRAC3": 0.772, "IRAC4": 0.737}
IRAC_SYSTEMATIC = 0.02
WARM_MJD = 54966
MAD_SCALE = 1.482602218505602
# Bits that spoil a pixel.
BAD_BITS_VIS, BAD_BITS_NISP, STARSIGNAL_BIT = (0, 3, 22), (0, 10), 18
UNWISE_BITS = {"spike": (27, 28, 29, 30), "halo": (23, 24), "ghost": (11, 12, 25, 26)}
# Source models.
STAR_PROBABILITY = 0.96
SERSIC_N = (0.4, 6.0)
RADIUS_ARCSEC = (0.05, 20.0)
MODELS = ("PointSource", "SimpleGalaxy", "ExpGalaxy", "DevGalaxy", "CompositeGalaxy", "SersicGalaxy")
FREE_PARAMETERS = {"PointSource": 1, "SimpleGalaxy": 1, "ExpGalaxy": 4, "DevGalaxy": 4, "CompositeGalaxy": 8, "SersicGalaxy": 5}
# A(band) / E(B-V). Bands without one are left uncorrected.
EXTINCTION = {"VIS": 2.1018, "Y": 1.1346, "J": 0.8091, "H": 0.496, "W1": 0.19, "W2": 0.15, "IRAC1": 0.198, "IRAC2": 0.152, "IRAC3": 0.152, "IRAC4": 0.152}
BANDS = ("VIS", "Y", "J", "H", "W1", "W2", "IRAC1", "IRAC2", "IRAC3", "IRAC4")


def bit_mask(bits) -> int:
    return sum(1 << b for b in bits)


def bad_bits(band: str) -> tuple[int, ...]:
    return BAD_BITS_VIS if band.upper() == "VIS" else BAD_BITS_NISP


def normalize_channel(channel: str | int) -> str:
    """1, "1", "ch1", "channel1", "irac1" -> IRAC1."""
    c = str(channel).strip().upper().replace("_", "").replace(" ", "")
    for prefix in ("IRAC", "CHANNEL", "CH"):
        c = c.removeprefix(prefix)
    if c not in {"1", "2", "3", "4"}:
        raise ValueError(f"unknown channel {channel!r}")
    return f"IRAC{c}"


def mission(channel: str | int, mjd: float | None = None, date: str | None = None) -> str:
    """cryo or warm; channels 3 and 4 have cryogenic data alone."""
    if normalize_channel(channel) in ("IRAC3", "IRAC4"):
        return "cryo"
    if mjd is not None:
        return "warm" if mjd >= WARM_MJD else "cryo"
    return "warm" if date is not None and date[:10] >= "2009-05-15" else "cryo"


_PRIOR = {"mode": "catalog", "band": "VIS", "free_shapes": False, "refine_positions": False, "psf_product": "auto", "force_model": None, "flux_floor_ujy": 10.0}


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run; wrong ones raise ValueError."""

    ra: float
    dec: float
    size_arcsec: float = 50.0
    bands: tuple[str, ...] = ("VIS",)
    prior: dict = field(default_factory=dict)
    brightness_cut_ujy: float = 0.0
    max_rows: int | None = None
    with_flags: bool = True

    def __post_init__(self):
        unknown = set(self.prior) - set(_PRIOR)
        if unknown:
            raise ValueError(f"unknown prior settings: {sorted(unknown)}")
        object.__setattr__(self, "prior", _PRIOR | self.prior)
        if self.prior["mode"] not in ("catalog", "coords", "tree"):
            raise ValueError(f"prior mode {self.prior['mode']!r}")
        if self.prior["psf_product"] not in ("auto", "catalog", "grid"):
            raise ValueError(f"PSF product {self.prior['psf_product']!r}")
        if self.prior["force_model"] not in (None, *MODELS):
            raise ValueError(f"model {self.prior['force_model']!r}")
        bands = tuple(dict.fromkeys(b.upper() for b in self.bands))
        if bad := [b for b in bands if b not in BANDS]:
            raise ValueError(f"unknown bands: {bad}")
        object.__setattr__(self, "bands", bands)
        if not -90 <= self.dec <= 90 or self.size_arcsec <= 0:
            raise ValueError("the field lies off the sky or has no size")

    @property
    def psf_product(self) -> str:
        if self.prior["psf_product"] != "auto":
            return self.prior["psf_product"]
        return "grid" if self.prior["mode"] == "coords" else "catalog"
