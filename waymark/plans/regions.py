"""Own coarse outlines of the regions the presets ask about, and the sites.

Degrees, closed rings; a list of rings is a (multi)polygon under the even-odd rule.
"""

from __future__ import annotations

# Site number, name, longitude, latitude.
SITES = [
    (0, "Paris", 2.35, 48.86), (1, "Philadelphia", -75.16, 39.95), (2, "Istanbul", 28.98, 41.01),
    (3, "Baghdad", 44.36, 33.31), (4, "Tehran", 51.39, 35.69), (5, "Beijing", 116.41, 39.9),
    (6, "Tokyo", 139.69, 35.69), (7, "Oslo", 10.75, 59.91), (8, "Khartoum", 32.53, 15.5),
    (9, "Johannesburg", 28.05, -26.2), (10, "Los-Angeles", -118.24, 34.05), (11, "Bogota", -74.07, 4.71),
]

BEIJING_BOX = (115.4172, 39.4425, 117.5071, 41.0586)

BEIJING = [
    [(115.42, 39.62), (115.75, 39.51), (116.23, 39.45), (116.62, 39.6), (116.82, 39.53), (116.94, 39.78),
     (117.2, 40.08), (117.5, 40.12), (117.39, 40.23), (117.1, 40.68), (116.71, 40.91), (116.45, 40.77),
     (116.22, 41.05), (115.95, 40.6), (115.76, 40.17), (115.42, 39.62)],
    # a reservoir cut out of the shape
    [(116.8, 40.45), (117.0, 40.45), (117.0, 40.6), (116.8, 40.6), (116.8, 40.45)],
]
BEIJING_CENTER = [[
    (116.17, 39.85), (116.25, 39.79), (116.42, 39.8), (116.55, 39.88), (116.54, 39.99), (116.43, 40.04),
    (116.27, 40.03), (116.18, 39.96), (116.17, 39.85),
]]
CALIFORNIA = [[
    (-124.4, 42.0), (-120.0, 42.0), (-120.0, 39.0), (-114.63, 35.0), (-114.14, 34.3), (-114.72, 32.72),
    (-117.12, 32.54), (-118.4, 33.74), (-120.65, 34.55), (-121.9, 36.6), (-122.5, 37.5), (-123.8, 39.3),
    (-124.4, 40.4), (-124.4, 42.0),
]]
USA = [[
    (-124.7, 48.4), (-123.0, 49.0), (-95.0, 49.0), (-83.0, 46.0), (-82.5, 42.0), (-79.0, 43.3), (-75.0, 45.0),
    (-69.0, 47.4), (-67.0, 44.8), (-70.5, 41.6), (-74.0, 40.5), (-75.5, 35.2), (-81.2, 31.0), (-80.1, 25.3),
    (-82.6, 28.0), (-84.5, 30.0), (-90.0, 29.0), (-97.2, 26.0), (-101.0, 29.7), (-106.5, 31.8), (-114.7, 32.7),
    (-117.1, 32.5), (-120.7, 34.5), (-124.4, 40.4), (-124.7, 48.4),
]]
ATLANTIC = [[
    (-79.0, 30.0), (-70.0, 40.0), (-52.0, 47.0), (-40.0, 60.0), (-20.0, 65.5), (-6.0, 58.0), (-10.0, 44.0),
    (-10.0, 36.0), (-18.0, 21.0), (-13.0, 8.0), (8.0, 3.0), (8.8, -5.0), (-20.0, -7.0), (-35.0, -5.0),
    (-50.0, 3.0), (-60.0, 13.0), (-79.0, 30.0),
]]
RUSSIA = [[
    (28.0, 59.5), (30.0, 69.0), (60.0, 69.0), (105.0, 77.5), (179.0, 69.0), (160.0, 60.0), (135.0, 44.0),
    (131.0, 43.0), (120.0, 50.0), (87.0, 49.5), (61.0, 51.0), (48.0, 46.0), (47.0, 42.0), (38.0, 46.5),
    (32.0, 52.0), (28.0, 59.5),
]]
FRANCE_REGIONS = {
    "Ile-de-France": [[(1.45, 49.1), (1.9, 48.4), (2.9, 48.15), (3.5, 48.6), (3.1, 49.1), (1.7, 49.2), (1.45, 49.1)]],
    "Haute-Normandie": [[(0.1, 49.5), (0.3, 48.9), (1.45, 49.1), (1.7, 49.2), (1.4, 50.05), (0.1, 49.5)]],
    "Picardie": [[(1.4, 50.05), (1.7, 49.2), (3.1, 49.1), (4.1, 49.95), (2.7, 50.2), (1.4, 50.05)]],
    "Centre": [[(0.3, 48.9), (0.0, 47.0), (2.0, 46.4), (3.0, 47.6), (2.9, 48.15), (1.9, 48.4), (1.45, 49.1), (0.3, 48.9)]],
    "Bourgogne": [[(2.9, 48.15), (3.0, 47.6), (2.9, 46.8), (4.9, 46.3), (5.5, 47.3), (4.5, 48.0), (3.5, 48.6), (2.9, 48.15)]],
    "Corse": [[(8.6, 42.4), (8.8, 41.5), (9.3, 41.4), (9.5, 42.8), (9.3, 43.0), (8.6, 42.4)]],
}
SOUTH_AMERICA = {
    "Colombia": [[(-77.4, 8.5), (-75.5, 10.7), (-72.0, 12.0), (-72.5, 8.0), (-67.5, 6.0), (-67.0, 1.2), (-70.0, -4.2),
                  (-75.0, 0.0), (-78.8, 1.6), (-77.4, 8.5)]],
    "Venezuela": [[(-72.0, 12.0), (-62.0, 10.7), (-60.0, 8.3), (-61.0, 5.0), (-64.5, 1.0), (-67.0, 1.2), (-67.5, 6.0),
                   (-72.5, 8.0), (-72.0, 12.0)]],
    "Ecuador": [[(-78.8, 1.6), (-75.0, 0.0), (-76.5, -2.8), (-80.3, -4.4), (-80.9, -1.0), (-78.8, 1.6)]],
    "Peru": [[(-75.0, 0.0), (-70.0, -4.2), (-69.0, -12.5), (-70.4, -18.3), (-76.5, -14.0), (-81.2, -5.0),
              (-80.3, -4.4), (-76.5, -2.8), (-75.0, 0.0)]],
    "Brazil": [[(-70.0, -4.2), (-67.0, 1.2), (-60.0, 5.0), (-50.0, 3.0), (-35.0, -6.0), (-40.0, -20.0), (-53.5, -33.5),
                (-58.0, -20.0), (-69.0, -12.5), (-70.0, -4.2)]],
    "Falkland-Islands": [[(-61.0, -51.3), (-57.8, -51.3), (-57.8, -52.3), (-61.0, -52.3), (-61.0, -51.3)]],
}
CITY_BUFFER_KM = [10, 50, 150, 250, 350, 450, 550, 650]
PARIS_BUFFER_KM = [50, 150, 250, 350, 450, 550, 650]
FREE_BUFFER_KM = [10, 20, 30, 50, 80, 130, 200]
