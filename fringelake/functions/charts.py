"""Charts of orbits: coordinates without the singular points of the usual elements, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cx import Cx
from .geometry import floor_mod


def thiele_innes(u: Cx, v: Cx) -> tuple[Column, Column, Column, Column]:
    """(A, B, F, G) of two complex coordinates: u^2 = (A + G) + i (B - F) and v^2 = (A - G) - i (B + F)."""
    a, b = u * u, v * v
    return (a.re + b.re) / 2, (a.im - b.im) / 2, -(a.im + b.im) / 2, (a.re - b.re) / 2


def eccentricity_and_anomaly(zeta: Cx) -> tuple[Column, Column]:
    """(e, M): eccentricity |zeta|^2 and mean anomaly arg zeta."""
    return zeta.abs2(), zeta.arg()


def orientation(varpi: Column, node: Column | None = None, two_nodes: Column | None = None) -> tuple[Column, Column]:
    """(omega, Omega) in degrees from their sum and the node, or twice the node (then the node is in [0, 180))."""
    if (node is None) == (two_nodes is None):
        raise ValueError("give either the node or twice the node")
    node = floor_mod(two_nodes, 360.0) / 2 if node is None else node
    return floor_mod(varpi - node, 360.0), node


def position_angle_log_jacobian(theta: Column, ecc: Column, inc: Column, omega: Column, node: Column) -> Column:
    """log |dM / dtheta| at the position angle theta, for fixed other elements; degrees."""
    phi, cos_i = F.radians(theta - node), F.cos(F.radians(inc))
    f = F.atan2(F.sin(phi) / cos_i, F.cos(phi)) - F.radians(omega)
    across = F.pow(F.cos(phi) * cos_i, 2.0) + F.pow(F.sin(phi), 2.0)
    return 1.5 * F.log1p(-ecc * ecc) - 2.0 * F.log1p(ecc * F.cos(f)) + F.log(F.abs(cos_i)) - F.log(across)
