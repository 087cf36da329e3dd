"""Source models that compile to columns: a tree of components gives the complex visibility of a sample row."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import harmonics, special
from ..functions.cx import Cx, Number, col, real
from ..functions.geometry import MAS, deproject, gaussian_taper, offset_phase, rotate, sinc
from ..functions.orbits import Kepler

Param = Number | str


@dataclass(frozen=True)
class Uv:
    """A sample: baseline in wavelengths, and wavelength, bandwidth (metres) and time where a model needs them."""

    u: Column
    v: Column
    wavel: Column | None = None
    mjd: Column | None = None
    bandwidth: Column | None = None

    def moved(self, u: Column, v: Column) -> Uv:
        return Uv(u, v, self.wavel, self.mjd, self.bandwidth)


def samples_uv(mjd: bool = False, bandwidth: bool = False) -> Uv:
    """The columns of a samples table: u, v in metres, wavel in metres."""
    w = F.col("wavel")
    return Uv(F.col("u") / w, F.col("v") / w, w, F.col("mjd") if mjd else None, F.col("bandwidth") if bandwidth else None)


@dataclass(frozen=True, kw_only=True)
class Component:
    """Flux and offset of a source; a subclass gives the visibility about its own centre.

    A parameter is a number or the name of a column of the points table, so one plan serves one model or a grid.
    """

    flux: Param = 1.0
    dra: Param = 0.0
    ddec: Param = 0.0

    def centred(self, s: Uv) -> Cx:
        raise NotImplementedError

    def total(self, s: Uv) -> Column:
        return self.flux(s.wavel) if callable(self.flux) else col(self.flux)

    def place(self, s: Uv) -> tuple[Column, Column]:
        return col(self.dra), col(self.ddec)

    def cvis(self, s: Uv) -> Cx:
        x, y = self.place(s)
        out = self.centred(s)
        if not (self.dra == 0.0 and self.ddec == 0.0 and type(self).place is Component.place):
            out = out * offset_phase(s.u, s.v, x, y)
        if s.bandwidth is not None:
            out = out * sinc((s.u * x + s.v * y) * MAS * s.bandwidth / s.wavel)
        return out

    def parameters(self) -> set[str]:
        """Names of the columns that the tree reads."""
        out = set()
        for f in fields(self):
            x = getattr(self, f.name)
            parts = x if isinstance(x, tuple) else (x,)
            for p in parts:
                out |= {p} if isinstance(p, str) else p.parameters() if isinstance(p, Component) else set()
        return out


@dataclass(frozen=True, kw_only=True)
class PointSource(Component):
    def centred(self, s):
        return real(1.0)


@dataclass(frozen=True, kw_only=True)
class Resolved(Component):
    """Flux so extended that no baseline sees it."""

    def centred(self, s):
        return Cx(F.when((s.u == 0) & (s.v == 0), 1.0).otherwise(0.0), F.lit(0.0))


@dataclass(frozen=True, kw_only=True)
class GaussianDisk(Component):
    sigma: Param

    def centred(self, s):
        k = col(self.sigma) * MAS
        return Cx(F.exp((s.u * s.u + s.v * s.v) * k * k * (-2 * math.pi**2)), F.lit(0.0))


@dataclass(frozen=True, kw_only=True)
class EllipticalGaussian(Component):
    fwhm: Param
    ratio: Param = 1.0
    pa: Param = 0.0

    def centred(self, s):
        x, y = deproject(s.u, s.v, self.pa, self.ratio)
        return Cx(gaussian_taper(x * x + y * y, self.fwhm), F.lit(0.0))


@dataclass(frozen=True, kw_only=True)
class UniformDisk(Component):
    diam: Param

    def centred(self, s):
        x = F.hypot(s.u, s.v) * col(self.diam) * (math.pi * MAS)
        return Cx(special.j1_over_x(x) * 2.0, F.lit(0.0))


@dataclass(frozen=True, kw_only=True)
class LimbDarkenedDisk(Component):
    """Brightness 1 - sum u_k (1 - mu)^k over a disk; its transform by Gauss-Legendre rings of J0."""

    diam: Param
    u: tuple[Param, ...] = ()
    nodes: int = 24

    def centred(self, s):
        import numpy as np

        x, w = np.polynomial.legendre.leggauss(self.nodes)
        mus, weights = (x + 1) / 2, w / 2
        arg = self.spacing(s) * col(self.diam) * (math.pi * MAS)
        bright = [self.brightness(mu) * (wt * mu) for mu, wt in zip(mus.tolist(), weights.tolist())]
        top = special.hankel(arg, [F.lit(math.sqrt(1 - mu * mu)) for mu in mus.tolist()], bright)
        return Cx(top / sum(bright, F.lit(0.0)), F.lit(0.0))

    def spacing(self, s: Uv) -> Column:
        return F.hypot(s.u, s.v)

    def brightness(self, mu: float) -> Column:
        b = F.lit(1.0)
        for k, c in enumerate(self.u, 1):
            b = b - col(c) * (1 - mu) ** k
        return b


@dataclass(frozen=True, kw_only=True)
class EllipticalLimbDarkenedDisk(LimbDarkenedDisk):
    """The same with an elliptical outline: `diam` along the position angle, `ratio` times that across it."""

    ratio: Param = 1.0
    pa: Param = 0.0

    def spacing(self, s):
        return F.hypot(*deproject(s.u, s.v, self.pa, self.ratio))


@dataclass(frozen=True, kw_only=True)
class QuadraticLimbDarkenedDisk(LimbDarkenedDisk):
    """The quadratic law by q1, q2 of the unit square: u1 = 2 sqrt(q1) q2, u2 = sqrt(q1) (1 - 2 q2)."""

    q1: Param
    q2: Param

    def brightness(self, mu):
        root, q2 = F.sqrt(col(self.q1)), col(self.q2)
        return F.lit(1.0) - root * q2 * (2 * (1 - mu)) - root * (1.0 - q2 * 2.0) * (1 - mu) ** 2


@dataclass(frozen=True, kw_only=True)
class SquareRootLimbDarkenedDisk(QuadraticLimbDarkenedDisk):
    """The square-root law by q1, q2: 1 - sqrt(q1) (1 - 2 q2) (1 - mu) - 2 sqrt(q1) q2 (1 - sqrt(mu))."""

    nodes: int = 48

    def brightness(self, mu):
        root, q2 = F.sqrt(col(self.q1)), col(self.q2)
        return F.lit(1.0) - root * (1.0 - q2 * 2.0) * (1 - mu) - root * q2 * (2 * (1 - math.sqrt(mu)))


@dataclass(frozen=True, kw_only=True)
class Profile:
    """A radial brightness; `between` bounds it and Gauss-Legendre nodes carry brightness times radius."""

    nodes: int = 32

    def between(self) -> tuple[Column, Column]:
        raise NotImplementedError

    def intensity(self, r: Column) -> Column:
        raise NotImplementedError

    def rings(self) -> list[tuple[Column, Column]]:
        """(radius in mas, weight) of the thin rings that stand for the profile."""
        import numpy as np

        lo, hi = self.between()
        half, out = (hi - lo) / 2.0, []
        for x, w in zip(*(a.tolist() for a in np.polynomial.legendre.leggauss(self.nodes))):
            r = lo + half * (x + 1)
            out.append((r, half * w * r * self.intensity(r)))
        return out

    def parameters(self) -> set[str]:
        own = (getattr(self, f.name) for f in fields(self))
        flat = [y for x in own for y in (x if isinstance(x, tuple) else (x,))]
        return {x for x in flat if isinstance(x, str)}.union(*(x.parameters() for x in flat if isinstance(x, Profile)))


@dataclass(frozen=True, kw_only=True)
class ThinRing(Profile):
    radius: Param

    def rings(self):
        return [(col(self.radius), F.lit(1.0))]


@dataclass(frozen=True, kw_only=True)
class GaussianRing(Profile):
    """A Gaussian of width `sigma` about `radius`, out to five widths."""

    radius: Param
    sigma: Param

    def between(self):
        r, s = col(self.radius), col(self.sigma) * 5.0
        return F.greatest(r - s, F.lit(0.0)), r + s

    def intensity(self, r):
        return F.exp(F.pow((r - col(self.radius)) / col(self.sigma), 2.0) * -0.5)


@dataclass(frozen=True, kw_only=True)
class RadialPowerLaw(Profile):
    """Brightness r ** index between two radii."""

    r_in: Param
    r_out: Param
    index: Param = 0.0

    def between(self):
        return col(self.r_in), col(self.r_out)

    def intensity(self, r):
        return F.pow(F.greatest(r, F.lit(1e-9)), col(self.index))


@dataclass(frozen=True, kw_only=True)
class ExpTail(Profile):
    """Brightness exp(-(r - r_in) / scale_length) from r_in out to `cutoff` lengths."""

    r_in: Param
    scale_length: Param
    cutoff: float = 10.0

    def between(self):
        return col(self.r_in), col(self.r_in) + col(self.scale_length) * self.cutoff

    def intensity(self, r):
        return F.exp((col(self.r_in) - r) / col(self.scale_length))


@dataclass(frozen=True, kw_only=True)
class Gap(Profile):
    """Another profile with a Gaussian part of depth `depth` taken out about `radius`."""

    base: Profile = field(default_factory=lambda: ThinRing(radius=1.0))
    radius: Param
    sigma: Param
    depth: Param = 1.0

    def rings(self):
        dip = lambda r: 1.0 - col(self.depth) * F.exp(F.pow((r - col(self.radius)) / col(self.sigma), 2.0) * -0.5)
        return [(r, w * dip(r)) for r, w in self.base.rings()]


@dataclass(frozen=True, kw_only=True)
class RadialSum(Profile):
    """Profiles added up as they are."""

    parts: tuple[Profile, ...] = ()

    def rings(self):
        return [ring for p in self.parts for ring in p.rings()]


@dataclass(frozen=True, kw_only=True)
class RadialDisk(Component):
    """A radial profile, round or seen at an angle: its Hankel transform by rings of J0."""

    profile: Profile
    ratio: Param = 1.0
    pa: Param = 0.0

    def centred(self, s):
        q = F.hypot(*deproject(s.u, s.v, self.pa, self.ratio)) * (2 * math.pi * MAS)
        rings = self.profile.rings()
        if len(rings) == 1:
            return Cx(special.j0(q * rings[0][0]), F.lit(0.0))
        radii, weights = zip(*rings)
        return Cx(special.hankel(q, radii, weights) / sum(weights, F.lit(0.0)), F.lit(0.0))

    def parameters(self):
        return super().parameters() | self.profile.parameters()


@dataclass(frozen=True, kw_only=True)
class Ring(Component):
    """A thin ring, round or seen at an angle, with azimuthal cosine and sine harmonics."""

    radius: Param
    cos: tuple[Param, ...] = ()
    sin: tuple[Param, ...] = ()
    ratio: Param = 1.0
    pa: Param = 0.0

    def centred(self, s):
        x, y = deproject(s.u, s.v, self.pa, self.ratio)
        arg, angle = F.hypot(x, y) * col(self.radius) * (2 * math.pi * MAS), F.atan2(x, y)
        re, im = special.j0(arg), F.lit(0.0)
        for m in range(1, max(len(self.cos), len(self.sin)) + 1):
            c = col(self.cos[m - 1]) if m <= len(self.cos) else F.lit(0.0)
            d = col(self.sin[m - 1]) if m <= len(self.sin) else F.lit(0.0)
            term = special.jn(m, arg) * (c * F.cos(angle * m) + d * F.sin(angle * m))
            # (-i)^m
            if m % 2:
                im = im + term * (-1.0 if m % 4 == 1 else 1.0)
            else:
                re = re + term * (-1.0 if m % 4 == 2 else 1.0)
        return Cx(re, im)


@dataclass(frozen=True, kw_only=True)
class Crescent(Component):
    """A disk less a smaller one inside it, displaced along a position angle by `ecc` of the room there is."""

    r_out: Param
    r_in: Param
    ecc: Param = 0.0
    pa: Param = 0.0

    def centred(self, s):
        out, inn, a = col(self.r_out), col(self.r_in), F.radians(col(self.pa))
        shift = (out - inn) * col(self.ecc)
        q = F.hypot(s.u, s.v) * (2 * math.pi * MAS)
        large = real(1.0) * (special.j1_over_x(q * out) * 2.0 * out * out)
        small = offset_phase(s.u, s.v, shift * F.sin(a), shift * F.cos(a)) * (special.j1_over_x(q * inn) * 2.0 * inn * inn)
        return (large - small) / (out * out - inn * inn)


@dataclass(frozen=True, kw_only=True)
class MultipoleDisk(Component):
    """A disk of a radial profile whose rings have harmonics 1 + sum of c_m cos m t + s_m sin m t, m from 1, seen inclined.

    t is the azimuth in the disk from the major axis towards pa + 90 degrees. Rings lie `opening` times their radius above
    the plane. All orders of a ring come from one downward recurrence.
    """

    profile: Profile
    c: tuple[float, ...] = ()
    s: tuple[float, ...] = ()
    inc: Param = 0.0
    pa: Param = 0.0
    opening: Param = 0.0

    def centred(self, s):
        pairs = self.profile.rings()
        rings = F.array(*(F.struct(r.cast("double").alias("r"), w.cast("double").alias("w")) for r, w in pairs))
        inc = F.radians(col(self.inc))
        minor, major = deproject(s.u, s.v, self.pa, 1.0)
        short = minor * F.cos(inc)
        q, phi = F.hypot(short, major) * (2 * math.pi * MAS), F.atan2(short, major)
        lift = minor * F.sin(inc) * col(self.opening) * (-2 * math.pi * MAS)

        def add(total: Column, ring: Column) -> Column:
            c, n = F.cos(lift * ring["r"]), F.sin(lift * ring["r"])
            turned = lambda z: F.struct((total["re"] + ring["w"] * (z["re"] * c - z["im"] * n)).alias("re"), (total["im"] + ring["w"] * (z["re"] * n + z["im"] * c)).alias("im"), (total["w"] + ring["w"]).alias("w"))
            # a ring's sum is worked out once and then turned
            return F.transform(F.array(harmonics.ring_harmonics(q * ring["r"], phi, list(self.c), list(self.s))), turned)[0]

        none = F.struct(*(F.lit(0.0).alias(k) for k in ("re", "im", "w")))
        total = F.aggregate(rings, none, add)
        return Cx(total["re"] / total["w"], total["im"] / total["w"])

    def parameters(self) -> set[str]:
        return {p for p in (self.flux, self.dra, self.ddec, self.inc, self.pa, self.opening) if isinstance(p, str)} | self.profile.parameters()


@dataclass(frozen=True, kw_only=True)
class System(Component):
    """Components weighted by flux, then moved together."""

    parts: tuple[Component, ...] = ()

    def centred(self, s):
        top, bottom = Cx(F.lit(0.0), F.lit(0.0)), F.lit(0.0)
        for p in self.parts:
            f = p.total(s)
            top, bottom = top + p.cvis(s) * f, bottom + f
        return top / bottom


@dataclass(frozen=True, kw_only=True)
class Rotated(Component):
    source: Component = field(default_factory=PointSource)
    rotation: Param = 0.0

    def centred(self, s):
        return self.source.cvis(s.moved(*rotate(s.u, s.v, self.rotation)))


@dataclass(frozen=True, kw_only=True)
class Blurred(Component):
    source: Component = field(default_factory=PointSource)
    fwhm: Param = 0.0

    def centred(self, s):
        return self.source.cvis(s) * gaussian_taper(s.u * s.u + s.v * s.v, self.fwhm)


@dataclass(frozen=True, kw_only=True)
class BinaryCartesian(Component):
    """A star at the centre and a companion of flux ratio `ratio` at an offset in mas."""

    x: Param
    y: Param
    ratio: Param

    def companion(self, s: Uv) -> tuple[Column, Column]:
        return col(self.x), col(self.y)

    def centred(self, s):
        x, y = self.companion(s)
        f = col(self.ratio)
        second = offset_phase(s.u, s.v, x, y)
        if s.bandwidth is not None:
            second = second * sinc((s.u * x + s.v * y) * MAS * s.bandwidth / s.wavel)
        return (real(1.0) + second * f) / (f + 1.0)


@dataclass(frozen=True, kw_only=True)
class BinaryAngular(BinaryCartesian):
    """The same by separation and position angle."""

    x: Param = 0.0
    y: Param = 0.0
    sep: Param
    pa: Param

    def companion(self, s):
        a = F.radians(col(self.pa))
        return col(self.sep) * F.sin(a), col(self.sep) * F.cos(a)


@dataclass(frozen=True, kw_only=True)
class OrbitalBinary(BinaryCartesian):
    """The same on an orbit, at each sample's own time."""

    x: Param = 0.0
    y: Param = 0.0
    orbit: Kepler

    def companion(self, s):
        return self.orbit.relative(s.mjd)

    def parameters(self):
        return super().parameters() | {x for f in fields(self.orbit) if isinstance(x := getattr(self.orbit, f.name), str)}


@dataclass(frozen=True, kw_only=True)
class Attached(Component):
    """A component that follows an orbit at each sample's own time."""

    source: Component = field(default_factory=PointSource)
    orbit: Kepler

    def centred(self, s):
        return self.source.cvis(s) * offset_phase(s.u, s.v, *self.orbit.relative(s.mjd))

    def parameters(self):
        return super().parameters() | {x for f in fields(self.orbit) if isinstance(x := getattr(self.orbit, f.name), str)}
