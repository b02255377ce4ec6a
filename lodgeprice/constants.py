"""Fixed values that must equal the original application's for equal results.

FIXED VALUES — listed plainly, in their natural order. Do not edit.
"""

from __future__ import annotations

# FIXED VALUES: reference date for host experience (days from host_since).
REFERENCE_DATE = "2025-09-24"

# FIXED VALUES: columns kept from the raw listing scrape, in this order.
KEEP_COLUMNS = [
    "id", "host_since", "host_total_listings_count", "price", "accommodates", "bedrooms", "beds", "room_type",
    "neighbourhood_group_cleansed", "latitude", "longitude", "amenities", "bathrooms_text",
    "review_scores_rating", "property_type", "number_of_reviews",
    "review_scores_accuracy", "review_scores_cleanliness", "review_scores_checkin",
    "review_scores_communication", "review_scores_location", "review_scores_value",
]

# FIXED VALUES: the seven review score columns.
REVIEW_COLUMNS = [
    "review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness", "review_scores_checkin",
    "review_scores_communication", "review_scores_location", "review_scores_value",
]

# FIXED VALUES: landmarks (name, latitude, longitude), in this order.
LANDMARKS = [
    ("Brandenburger Tor", 52.516275, 13.377704),
    ("Alexanderplatz", 52.521918, 13.413215),
    ("Reichstagsgebäude", 52.518620, 13.376187),
    ("Potsdamer Platz", 52.509168, 13.376641),
    ("Siegessäule", 52.514543, 13.350119),
    ("Tiergarten", 52.509778, 13.357260),
]

# FIXED VALUES: the 20 amenities turned into flags, in this order.
AMENITIES = [
    "Wifi", "Kitchen", "Air conditioning", "Free parking", "Washer", "Dryer",
    "Heating", "TV", "Dishwasher", "Refrigerator", "Microwave", "Coffee maker",
    "Hot water", "Smoke alarm", "Essentials", "Hair dryer", "Iron", "Bed linens",
    "Shampoo", "Free washer",
]

# FIXED VALUES: serving-side district names (12), room types (4) and property types (15 + Other).
NEIGHBOURHOODS = [
    "Pankow", "Neukoelln", "Mitte", "Friedrichshain-Kreuzberg",
    "Charlottenburg-Wilm.", "Tempelhof-Schoeneberg", "Lichtenberg",
    "Steglitz-Zehlendorf", "Treptow-Koepenick", "Reinickendorf",
    "Marzahn-Hellersdorf", "Spandau",
]
ROOM_TYPES = ["Entire home/apt", "Private room", "Shared room", "Hotel room"]
PROPERTY_TYPES = [
    "Entire rental unit", "Private room in rental unit", "Entire condo",
    "Entire serviced apartment", "Room in hotel", "Private room in condo",
    "Entire loft", "Private room in home", "Entire home",
    "Private room in bed and breakfast", "Private room in hostel",
    "Entire guesthouse", "Room in boutique hotel", "Shared room in hostel",
    "Room in aparthotel", "Other",
]

# FIXED VALUES: serving-side district name -> raw data district name.
NEIGHBOURHOOD_TO_RAW = {
    "Neukoelln": "Neukölln",
    "Tempelhof-Schoeneberg": "Tempelhof - Schöneberg",
    "Treptow-Koepenick": "Treptow - Köpenick",
    "Steglitz-Zehlendorf": "Steglitz - Zehlendorf",
    "Marzahn-Hellersdorf": "Marzahn - Hellersdorf",
    "Charlottenburg-Wilm.": "Charlottenburg-Wilm.",
    "Friedrichshain-Kreuzberg": "Friedrichshain-Kreuzberg",
    "Pankow": "Pankow",
    "Mitte": "Mitte",
    "Lichtenberg": "Lichtenberg",
    "Spandau": "Spandau",
    "Reinickendorf": "Reinickendorf",
}

# FIXED VALUES: geocoder district key -> serving district, tried in this order (first substring hit wins).
SUBURB_TO_NEIGHBOURHOOD = [
    ("Mitte", "Mitte"),
    ("Friedrichshain", "Friedrichshain-Kreuzberg"),
    ("Kreuzberg", "Friedrichshain-Kreuzberg"),
    ("Pankow", "Pankow"),
    ("Prenzlauer Berg", "Pankow"),
    ("Charlottenburg", "Charlottenburg-Wilm."),
    ("Wilmersdorf", "Charlottenburg-Wilm."),
    ("Spandau", "Spandau"),
    ("Steglitz", "Steglitz-Zehlendorf"),
    ("Zehlendorf", "Steglitz-Zehlendorf"),
    ("Tempelhof", "Tempelhof-Schoeneberg"),
    ("Schöneberg", "Tempelhof-Schoeneberg"),
    ("Neukölln", "Neukoelln"),
    ("Treptow", "Treptow-Koepenick"),
    ("Köpenick", "Treptow-Koepenick"),
    ("Reinickendorf", "Reinickendorf"),
    ("Lichtenberg", "Lichtenberg"),
    ("Marzahn", "Marzahn-Hellersdorf"),
    ("Hellersdorf", "Marzahn-Hellersdorf"),
]

# FIXED VALUES: serving limits and guards.
MAX_DISTANCE_KM = 15.0
MAX_ACCOMMODATES = 15
MAX_BEDROOMS = 10
MAX_BEDS = 10
MAX_BATHROOMS = 5
MIN_PRICE = 30.0
MAX_TRAIN_PRICE = 3000.0
PROFESSIONAL_HOST_MIN_LISTINGS = 2  # strictly more than this
TOP_PROPERTY_TYPES = 15
SIMILAR_K = 100
EARTH_RADIUS_KM = 6371.0

# FIXED VALUES: split and search settings.
SPLIT_SEED = 10
TEST_FRACTION = 0.2
CV_FOLDS = 5
SEARCH_ITER = 12

# FIXED VALUES: hard fallbacks for the default-value table (13 keys, in this order).
DEFAULT_AVERAGES = {
    "host_experience_days": 365.0,
    "num_listings": 1.0,
    "review_scores_rating": 4.7,
    "review_scores_accuracy": 4.7,
    "review_scores_cleanliness": 4.7,
    "review_scores_checkin": 4.7,
    "review_scores_communication": 4.7,
    "review_scores_location": 4.7,
    "review_scores_value": 4.7,
    "number_of_reviews": 50.0,
    "bedrooms": 1.0,
    "beds": 1.0,
    "bathrooms": 1.0,
}

# FIXED VALUES: features of the similarity search, in this order.
KNN_FEATURES = ["latitude", "longitude", "accommodates", "bedrooms", "beds", "bathrooms_numeric", "price_clean"]

# FIXED VALUES: raw columns of a comparable listing, in the order they are shown.
COMPS_COLUMNS = [
    "id", "latitude", "longitude", "price", "review_scores_rating", "property_type", "room_type", "bedrooms",
    "neighbourhood_group_cleansed", "beds", "accommodates", "bathrooms_text", "number_of_reviews",
]

# FIXED VALUES: serving model preference, then lowest RMSE.
PREFERRED_MODELS = ["catboost_tuned.joblib", "catboost.joblib"]
DEFAULT_MODEL_SERVING = "catboost_tuned.joblib"
DEFAULT_MODEL_REPORTS = "xgboost"

# FIXED VALUES: the 80 feature names in the order the serving side sends them to the model.
SERVED_FEATURE_ORDER = [
    "accommodates", "bedrooms", "beds", "review_scores_rating", "number_of_reviews",
    "review_scores_accuracy", "review_scores_cleanliness", "review_scores_checkin",
    "review_scores_communication", "review_scores_location", "review_scores_value",
    "host_experience", "is_professional_host",
    "is_entire_home_apt", "is_private_room", "is_shared_room", "is_hotel_room",
    "is_pankow", "is_neukoelln", "is_mitte", "is_friedrichshain_kreuzberg",
    "is_charlottenburg_wilm", "is_tempelhof_schoeneberg", "is_lichtenberg",
    "is_steglitz_zehlendorf", "is_treptow_koepenick", "is_reinickendorf",
    "is_marzahn_hellersdorf", "is_spandau",
    "dist_brandenburger_tor", "dist_alexanderplatz", "dist_reichstagsgebaeude",
    "dist_potsdamer_platz", "dist_siegessaeule", "dist_tiergarten",
    "has_wifi", "has_kitchen", "has_air_conditioning", "has_free_parking",
    "has_washer", "has_dryer", "has_heating", "has_tv", "has_dishwasher",
    "has_refrigerator", "has_microwave", "has_coffee_maker", "has_hot_water",
    "has_smoke_alarm", "has_essentials", "has_hair_dryer", "has_iron",
    "has_bed_linens", "has_shampoo", "has_free_washer",
    "bathrooms",
    "property_entire_rental_unit", "property_private_room_in_rental_unit",
    "property_entire_condo", "property_entire_serviced_apartment",
    "property_room_in_hotel", "property_private_room_in_condo",
    "property_entire_loft", "property_private_room_in_home", "property_entire_home",
    "property_private_room_in_bed_and_breakfast", "property_private_room_in_hostel",
    "property_entire_guesthouse", "property_room_in_boutique_hotel",
    "property_shared_room_in_hostel", "property_room_in_aparthotel", "property_other",
    "bedroom_density", "beds_per_person", "bathrooms_per_person", "total_rooms",
    "avg_dist_to_landmark", "review_score_std", "min_dist_to_landmark", "total_amenities",
]
