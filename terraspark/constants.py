"""Fixed values of the data model: they decide results and are kept as they are."""

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
#: lon min, lat min, lon max, lat max.
AFRICA = (-25.0, -35.0, 55.0, 38.0)

CATEGORIES = ("market", "mosque", "church", "school", "university", "hospital", "fuel_station", "telecom_tower", "bank", "restaurant", "hotel", "transport_stop", "government", "residential", "commercial")
LANDMARKS = ("mosque", "church", "university", "hospital", "telecom_tower", "government", "transport_stop", "market")

#: Names by which a category may be given.
CATEGORY_ALIASES = {
    "market": ("market", "marketplace", "bazaar", "souk"),
    "mosque": ("mosque", "masjid"),
    "church": ("church", "chapel", "cathedral"),
    "school": ("school", "primary_school", "secondary_school"),
    "university": ("university", "college"),
    "hospital": ("hospital", "clinic", "health_centre", "health_center"),
    "fuel_station": ("fuel_station", "fuel", "petrol_station", "gas_station"),
    "telecom_tower": ("telecom_tower", "tower", "mast", "communication_tower"),
    "bank": ("bank", "atm"),
    "restaurant": ("restaurant", "cafe", "fast_food", "food_court"),
    "hotel": ("hotel", "motel", "guesthouse", "hostel"),
    "transport_stop": ("transport_stop", "bus_stop", "train_station", "station", "ferry_terminal"),
    "government": ("government", "government_office", "town_hall", "courthouse"),
    "residential": ("residential", "house", "apartment"),
    "commercial": ("commercial", "shop", "mall", "supermarket"),
}
#: Values of map tags that stand for a category.
TAG_CATEGORIES = {
    "market": ("marketplace", "market"),
    "mosque": ("mosque", "masjid"),
    "church": ("church", "chapel", "cathedral", "place_of_worship"),
    "school": ("school", "kindergarten"),
    "university": ("university", "college"),
    "hospital": ("hospital", "clinic", "doctors", "pharmacy", "health_centre"),
    "fuel_station": ("fuel",),
    "telecom_tower": ("tower", "mast", "communication_tower"),
    "bank": ("bank", "atm"),
    "restaurant": ("restaurant", "cafe", "fast_food", "food_court", "bar"),
    "hotel": ("hotel", "motel", "hostel", "guest_house"),
    "transport_stop": ("bus_station", "train_station", "ferry_terminal", "bus_stop", "station"),
    "government": ("townhall", "courthouse", "government"),
    "residential": ("residential", "apartments", "house"),
    "commercial": ("supermarket", "mall", "convenience", "commercial", "retail"),
}
TAG_PRIORITY = ("amenity", "shop", "tourism", "building", "place", "landuse")
#: What a search for a category covers.
SEARCH_GROUPS = {
    "restaurant": ("restaurant", "cafe", "fast_food", "food_court"),
    "hotel": ("hotel", "motel", "guest_house", "hostel"),
    "hospital": ("hospital", "clinic", "doctors", "pharmacy"),
    "bank": ("bank", "atm"),
    "mosque": ("mosque",),
    "church": ("church", "chapel", "cathedral"),
    "market": ("market", "marketplace", "supermarket"),
    "fuel": ("fuel_station", "gas_station"),
    "school": ("school", "university", "college"),
    "transport": ("bus_stop", "bus_station", "taxi", "trotro"),
}
ISSUE_TYPES = ("wrong_turn", "road_closed", "better_route", "roundabout_error", "missing_road", "speed_wrong", "other")

#: Words of spatial relations by language, in the order in which they are tried.
RELATIONS = {
    "en": (("near", "near"), ("behind", "behind"), ("past", "past"), ("beside", "beside"), ("opposite", "opposite")),
    "fr": (("près de", "near"), ("derrière", "behind"), ("après", "past"), ("à côté de", "beside"), ("entre", "between"), ("en face de", "opposite")),
    "ar": (("بالقرب من", "near"), ("خلف", "behind"), ("بعد", "past"), ("بجانب", "beside"), ("بين", "between"), ("مقابل", "opposite")),
}
STREET_SUFFIXES = ("Street", "Road", "Avenue", "Blvd", "Lane")

ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "track", "path")
SURFACES = ("paved", "unpaved", "track", "unknown")
ACCESS = ("yes", "no", "designated")
HIGHWAY_CLASS = {
    0: ("motorway", "motorway_link"),
    1: ("trunk", "trunk_link"),
    2: ("primary", "primary_link"),
    3: ("secondary", "secondary_link"),
    4: ("tertiary", "tertiary_link"),
    5: ("unclassified", "residential", "living_street", "service"),
    6: ("track",),
    7: ("path", "footway", "cycleway"),
}
SURFACE_CLASS = {
    0: ("paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "sett", "cobblestone", "paving_stones"),
    1: ("unpaved", "gravel", "fine_gravel", "compacted", "dirt", "earth", "sand", "mud", "ground"),
    2: ("grass", "grass_paver"),
}
ACCESS_CLASS = {1: ("no", "private"), 2: ("designated",)}
DEFAULT_SPEEDS = (120.0, 100.0, 80.0, 60.0, 50.0, 30.0, 20.0, 10.0)
SURFACE_FACTORS = (1.0, 0.5, 0.3, 0.8)
#: km/h by road class; 0 is closed.
PROFILE_SPEEDS = {
    "bicycle": (0.0, 0.0, 20.0, 18.0, 16.0, 14.0, 12.0, 10.0),
    "car": (120.0, 100.0, 80.0, 60.0, 50.0, 30.0, 0.0, 0.0),
    "foot": (0.0, 0.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0),
    "motorcycle": (100.0, 80.0, 70.0, 55.0, 45.0, 30.0, 25.0, 15.0),
}
#: Tolerance in degrees of line simplification by largest zoom.
TOLERANCES = ((2, 0.01), (5, 0.005), (8, 0.001), (11, 0.0005), (14, 0.0001), (22, 0.00005))
TILE_PROPERTIES = ("name", "highway", "building", "landuse", "natural", "amenity", "shop", "tourism", "place", "waterway", "leisure", "railway")
POINT_KEYS = ("place", "amenity", "shop", "tourism", "natural", "historic", "leisure")
LINE_KEYS = ("highway", "railway", "waterway")
AREA_KEYS = ("building", "landuse", "natural", "leisure", "amenity")
