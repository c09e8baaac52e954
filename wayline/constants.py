"""Fixed values of the map data model."""

# Positions are whole numbers of 1e-7 degrees.
E7 = 1e7
EARTH_M = 6_371_008.8
EARTH_STATION_M = 6_371_000.0

# Road, rail and ferry runs end at gaps of more than this many metres.
GAP_M = 300.0
# Summary bins close at this many metres.
BIN_M = 500.0

DRIVE_COMPONENTS = ["view", "water", "vista", "relief", "above", "curvy", "open_sides", "cover", "built", "buildings", "scenic_route", "viewpoint"]
RIDE_COMPONENTS = ["view", "water", "vista", "relief", "height_or_depth", "altitude", "bridge", "tunnel", "grade", "curvy", "trains"]
CHANNELS = ["view", "water", "relief", "tpi", "curvy", "enclosure", "built", "flags", "vista", "open", "cover", "treeh", "bldg"]
FLAG_SCENIC_ROUTE, FLAG_PARK, FLAG_VIEWPOINT = 1, 2, 4
SAMPLE_TUNNEL, SAMPLE_BRIDGE, SAMPLE_RAIL = 1, 2, 4

LANDMARK_KINDS = ["viewpoint", "peak", "waterfall", "lighthouse", "covered_bridge", "rest", "trailhead", "heritage"]
HERITAGE_TIERS = ["w.c", "w.n", "n.top", "n.second", "n.lower", "n.mon", "n.land", "n.hist", "n.fed", "p.des", "p.reg", "p.area", "m.des", "m.reg", "m.area", "m.agr"]
MARK_NAMED, MARK_COMPONENT, MARK_PICNIC = 1, 2, 4
ISOLATION_UNKNOWN_KM = 20_000.0
KEEP_BALANCES = [0.0, 0.25, 0.5, 0.75, 1.0]
