import math

import pytest

from lumaflow.functions import color
from lumaflow.model import Calibration, ContractError, Extent, Phase, orientation_of_flip


def close(a, b, tol=1e-12):
    assert all(abs(x - y) <= tol for x, y in zip(a, b, strict=True)), (a, b)


def test_white_maps_to_d65():
    close(color.apply(color.rgb_to_xyz(), (1, 1, 1)), color.white_xyz(color.D65))


def test_luminance_weights():
    close(color.rgb_to_xyz()[1], (0.262700212, 0.677998072, 0.059301716), 1e-8)


def test_inverse():
    m = color.rgb_to_xyz()
    for i, row in enumerate(color.mul(m, color.inverse(m))):
        close(row, [float(i == j) for j in range(3)])


def test_adaptation_moves_white():
    close(color.apply(color.adaptation((0.44757, 0.40745)), color.white_xyz((0.44757, 0.40745))), color.white_xyz(color.D65))


@pytest.mark.parametrize("balance", [None, (2.0, 1.0, 4.0, 1.0)])
def test_camera_matrix_recovers_xyz(balance):
    """With XYZ as camera space, native values times gains come back as the same XYZ up to the reference scale."""
    identity = ((1.0, 0, 0), (0, 1.0, 0), (0, 0, 1.0), (0, 0, 0))
    native = (0.2, 0.3, 0.4)
    gained = [v * (balance[i] if balance else 1) for i, v in enumerate(native)]
    rgb = color.apply(color.camera_matrix(identity, balance), gained)
    xyz = color.apply(color.rgb_to_xyz(), rgb)
    close(xyz, native, 1e-12)


def test_as_shot_white_of_neutral_gains():
    xyz_to_cam = (*color.inverse(color.rgb_to_xyz()), (0, 0, 0))
    close(color.as_shot_white(xyz_to_cam, (1.0, 1.0, 1.0, 1.0)), color.D65, 1e-12)


def test_sigmoid_fixed_points():
    k = color.sigmoid_coefficients(1.5, -0.2)
    assert color.sigmoid_curve(0, k) == 0
    assert abs(color.sigmoid_curve(0.18, k) - 0.18) < 1e-12
    assert abs(color.sigmoid_curve(3e38, k) - 1) < 1e-6


def test_balance_takes_first_green():
    assert color.as_shot_balance((2.0, 1.0, 4.0, 0.0)) == (2.0, 1.0, 4.0, 1.0)
    with pytest.raises(ValueError):
        color.as_shot_balance((0.0, 1.0, 1.0, 1.0))


def test_site_levels():
    c = Calibration(cfa=((0, 1), (3, 2)), black=100, channel_black=(10, 20, 30, 40), pattern=(1, 2, (5, 7)), maximum=1100)
    assert c.range == 985
    close(c.site_levels, [1, 973 / 985, 955 / 985, 963 / 985])


def test_model_limits():
    with pytest.raises(ContractError):
        Extent(0, 5)
    with pytest.raises(ContractError):
        Extent(1 << 16, 1 << 16)
    assert Phase.of_cfa(((1, 0), (2, 3))) is Phase.GRBG
    with pytest.raises(ContractError):
        Phase.of_cfa(((0, 0), (1, 2)))
    assert [orientation_of_flip(f) for f in (*range(8), 9, -1)] == [1, 2, 4, 3, 5, 8, 6, 7, 1, 1]
    assert math.isclose(sum(color.rgb_to_xyz()[1]), 1)
