"""Word lists, hosts, brands, places and field aliases.

These are plain data. Results depend on them being exactly these values, in
this order, because the first match of a list is the one reported.
"""

BOOKING_HOSTS = [
    "vagaro.com", "fresha.com", "styleseat.com", "booksy.com", "booksy.net",
    "squareup.com", "glossgenius.com", "boulevard.io", "getboulevard.com",
    "schedulicity.com", "setmore.com", "mindbodyonline.com", "phorest.com",
    "salonrunner.com", "treatwell.co.uk", "treatwell.com",
    "acuityscheduling.com", "calendly.com", "simplybook.me", "bookwhen.com",
    "timely.com", "gettimely.com", "shedul.com", "salonized.com", "booker.com",
    "go.booker.com", "zenoti.com", "meevo.com", "rosy.com", "daysmart.com",
    "mynewbooking.com", "bychronos.com", "blismo.com", "getsquire.com",
    "thecut.co", "prcny.co", "barberly.app",
]
SOCIAL_HOSTS = [
    "facebook.com", "fb.com", "fb.me", "instagram.com", "instagr.am",
    "tiktok.com", "twitter.com", "x.com", "yelp.com", "yelp.ca",
    "linkedin.com", "linktr.ee", "youtube.com", "youtu.be", "pinterest.com",
    "wa.me", "whatsapp.com", "api.whatsapp.com", "t.me", "snapchat.com",
    "nextdoor.com", "bit.ly", "beacons.ai", "carrd.co",
]
BUILDER_HOSTS = [
    "square.site", "business.site", "sites.google.com", "business.google.com",
    "wixsite.com", "weebly.com", "godaddysites.com", "myshopify.com",
    "webnode.com", "webnode.at", "jimdosite.com", "blogspot.com",
    "wordpress.com",
]
HOST_PACKS = [
    ("web-presence/booking-hosts", "booking_only", BOOKING_HOSTS),
    ("web-presence/social-hosts", "social_only", SOCIAL_HOSTS),
    ("web-presence/site-builders", "builder", BUILDER_HOSTS),
]

CHAINS = {
    "Specsavers": 900, "Vision Express": 550, "Boots Opticians": 550,
    "Bupa Dental Care": 400, "mydentist": 550, "Portman Dental Care": 200,
    "Rodericks Dental": 150, "Aspen Dental": 1000, "Western Dental": 350,
    "Banfield Pet Hospital": 1000, "VCA Animal Hospitals": 1000,
    "Vets4Pets": 450, "Medivet": 300, "Dyno-Rod": 200, "Pimlico Plumbers": 20,
    "Roto-Rooter": 600, "Mr. Rooter": 200, "ServiceMaster": 700,
    "CertaPro Painters": 350, "PureGym": 400, "Anytime Fitness": 5000,
    "The Gym Group": 240, "Toni & Guy": 250, "Supercuts": 2000,
    "Great Clips": 4000,
}
DEFAULT_LOCATIONS = 99

TRADES = {
    "trades/dentist": {
        "label": "Dentist",
        "categories": ["Dentist", "Dental clinic", "Dental implants periodontist",
                       "Cosmetic dentist", "Orthodontist", "Pediatric dentist",
                       "Emergency dental service", "Dental hygienist"],
        "keywords": ["dentist", "dental", "orthodont", "endodont", "periodont"],
        "locale_terms": ["zahnarzt", "dentiste", "dentista"],
        "vetoes": ["dental laboratory", "dental supply store", "medical supply store"],
    },
    "trades/hvac": {
        "label": "HVAC contractor",
        "categories": ["HVAC contractor", "Air conditioning contractor",
                       "Heating contractor", "Furnace repair service",
                       "Air conditioning repair service"],
        "keywords": ["hvac", "air conditioning", "heating and cooling", "furnace",
                     "climate control"],
        "locale_terms": ["klimaanlage", "climatisation"],
        "vetoes": ["auto air conditioning service", "car repair", "appliance store"],
    },
    "trades/medical": {
        "label": "Medical clinic",
        "categories": ["Medical clinic", "Urgent care center",
                       "Family practice physician", "General practitioner",
                       "Walk-in clinic", "Medical Center"],
        "keywords": ["medical clinic", "urgent care", "family medicine",
                     "walk-in clinic"],
        "locale_terms": [],
        "vetoes": ["medical supply store", "pharmacy", "medical laboratory",
                   "health insurance agency"],
    },
    "trades/painting": {
        "label": "Painting contractor",
        "categories": ["Painter", "Painting", "Painting contractor", "House painter"],
        "keywords": ["painting", "painter", "wall painting", "texture painting"],
        "locale_terms": [],
        "vetoes": ["paint store", "paintings store", "gypsum product supplier",
                   "building materials", "house cleaning service", "plumber",
                   "painting class"],
    },
    "trades/roofing": {
        "label": "Roofing contractor",
        "categories": ["Roofing contractor", "Roofer", "Roofing service",
                       "Waterproofing service"],
        "keywords": ["roof", "roofing", "roofer", "shingle", "gutter"],
        "locale_terms": ["dakwerken", "dakdekker", "dachdecker", "couvreur",
                         "toiture", "toiturier", "takläggare", "taktekker"],
        "vetoes": ["water damage restoration", "insulation contractor",
                   "air conditioning contractor", "paving contractor",
                   "garage door supplier", "plumber", "interior designer",
                   "pest control", "road contractor"],
    },
    "trades/vet": {
        "label": "Veterinary clinic",
        "categories": ["Veterinarian", "Veterinary care", "Animal hospital",
                       "Emergency veterinarian"],
        "keywords": ["veterinary", "vet clinic", "animal hospital"],
        "locale_terms": [],
        "vetoes": ["pet groomer", "pet store", "pet supply store", "dog day care",
                   "restaurant"],
    },
}
SHARED_VETOES = [
    "warehouse", "apartment", "condominium", "housing society",
    "gated community", "community center", "real estate",
    "property investment", "property management", "car repair", "auto",
    "surveyor", "water skiing", "restaurant", "cafe", "bar", "tattoo shop",
    "art gallery", "art class", "art school", "art studio", "painting class",
    "college", "exhibit", "artist", "wholesaler", "distributor",
    "trading company", "supplier", "hardware store", "home goods store",
]
GENERIC_CATEGORIES = ["contractor", "service", "business", "general contractor",
                      "establishment"]

PLACES = {
    "geo/uk-affluent": [
        "Kensington, London", "Chelsea, London", "Richmond, London",
        "Islington, London", "Hampstead, London", "Wimbledon, London",
        "St Albans", "Guildford", "Winchester", "Harrogate", "Cheltenham",
        "Bath", "Oxford", "Cambridge", "Tunbridge Wells", "Solihull",
        "Altrincham", "Esher", "Beaconsfield", "Marlow"],
    "geo/us-metro": [
        "Manhattan, New York", "Brooklyn, New York", "San Francisco, California",
        "Los Angeles, California", "Chicago, Illinois", "Boston, Massachusetts",
        "Seattle, Washington", "Austin, Texas", "Denver, Colorado",
        "Miami, Florida", "Atlanta, Georgia", "Dallas, Texas", "Houston, Texas",
        "Philadelphia, Pennsylvania", "Phoenix, Arizona",
        "San Diego, California", "Portland, Oregon", "Nashville, Tennessee"],
    "geo/europe-english": [
        "Dublin", "Cork", "Galway", "Amsterdam", "Rotterdam", "The Hague",
        "Eindhoven", "Copenhagen", "Aarhus", "Stockholm", "Gothenburg", "Oslo",
        "Bergen", "Helsinki", "Zurich", "Geneva", "Luxembourg", "Brussels",
        "Malta"],
}

OSM_TRADE_TAGS = {
    "dentist": ["amenity=dentist", "healthcare=dentist"],
    "medical": ["amenity=doctors", "amenity=clinic", "healthcare=doctor"],
    "vet": ["amenity=veterinary", "healthcare=veterinary"],
    "roofing": ["craft=roofer"],
    "painting": ["craft=painter"],
    "hvac": ["craft=hvac", "craft=plumber"],
    "salon": ["shop=hairdresser", "shop=beauty"],
    "gym": ["leisure=fitness_centre", "amenity=gym"],
    "plumber": ["craft=plumber"],
    "electrician": ["craft=electrician"],
}
OSM_GUESS_KEYS = ["amenity", "shop", "healthcare", "craft", "office", "leisure", "tourism"]
OSM_CATEGORY_KEYS = ["craft", "shop", "amenity", "healthcare", "office", "leisure"]
OSM_ATTRIBUTION = "© OpenStreetMap contributors"

PARKING_HOSTS = [
    "sedoparking.com", "parkingcrew.net", "bodis.com", "afternic.com",
    "dan.com", "hugedomains.com", "godaddy.com/forsale", "buydomains.com",
    "namecheap.com/domains/registration", "domainmarket.com",
    "undeveloped.com", "porkbun.com/market", "squadhelp.com", "brandbucket.com",
]
PARKING_PHRASES = ["this domain may be for sale", "buy this domain",
                   "domain is for sale", "parked free, courtesy"]
PLATFORM_MARKERS = [
    ("wix", ["wix.com", "wixstatic.com", "x-wix-", "wixsite"]),
    ("squarespace", ["squarespace.com", "squarespace-cdn.com", "static1.squarespace"]),
    ("shopify", ["cdn.shopify.com", "shopify.com/s/", "shopify.theme"]),
    ("wordpress", ["wp-content", "wp-includes", "wp-json"]),
    ("godaddy", ["godaddysites.com", "img1.wsimg.com", "godaddy website builder"]),
    ("weebly", ["weebly.com", "weeblysite.com", "editmysite.com"]),
    ("webflow", ["webflow.com", "assets.website-files.com"]),
    ("duda", ["dudamobile.com", "multiscreensite.com", "duda.co"]),
    ("square", ["square.site", "squarespace-cdn", "squareup.com"]),
    ("facebook", ["facebook.com/plugins", "connect.facebook.net"]),
]
PLACEHOLDER_PHRASES = [
    "under construction", "coming soon", "site is being built",
    "default web page", "welcome to nginx", "apache2 ubuntu default",
    "this domain is parked", "future home of", "index of /",
    "account suspended", "website coming soon", "page not found",
]
EMAIL_NOISE = ["example.com", "sentry.io", "wixpress.com", "godaddy.com",
               "squarespace.com", "@2x", "@sentry", "domain.com", "email.com",
               "yourdomain", "@media", "u003e"]
SOCIAL_LINKS = [
    ("facebook", ["facebook.com/", "fb.com/"]),
    ("instagram", ["instagram.com/"]),
    ("linkedin", ["linkedin.com/company/", "linkedin.com/in/"]),
    ("x", ["twitter.com/", "x.com/"]),
    ("tiktok", ["tiktok.com/@"]),
    ("youtube", ["youtube.com/"]),
    ("whatsapp", ["wa.me/", "api.whatsapp.com/send"]),
]
SOCIAL_LINK_NOISE = ["sharer", "/share", "intent/", "/plugins/", "/tr?", "/dialog/",
                     "/embed/", "/watch?", "/hashtag/", "/policies"]
CONTACT_WORDS = ["contact", "kontakt", "contacto", "contatti", "contactez",
                 "get-in-touch", "impressum", "imprint", "about"]
NON_WEB_SCHEMES = ["mailto", "tel", "sms", "fax", "callto", "skype"]

PERM_CLOSED = ["permanently closed", "closed permanently"]
TEMP_CLOSED = ["temporarily closed", "closed temporarily"]

# Scripts by the word their characters' Unicode names carry, in check order.
SCRIPT_WORDS = [
    ("latin", "LATIN"), ("cyrillic", "CYRILLIC"), ("greek", "GREEK"),
    ("arabic", "ARABIC"), ("hebrew", "HEBREW"), ("devanagari", "DEVANAGARI"),
    ("han", "CJK"), ("hiragana", "HIRAGANA"), ("katakana", "KATAKANA"),
    ("hangul", "HANGUL"), ("thai", "THAI"), ("tamil", "TAMIL"),
    ("bengali", "BENGALI"), ("telugu", "TELUGU"),
]

HEADER_ALIASES = {
    "cid": ["cid", "place_id", "placeid", "google_id", "fid", "data_id"],
    "name": ["name", "title", "business_name", "businessname", "company"],
    "category": ["category", "categoryname", "main_category", "primary_category",
                 "type", "categories"],
    "address": ["address", "full_address", "formatted_address", "street_address"],
    "phone": ["phone", "phone_number", "telephone", "international_phone_number",
              "phoneunformatted"],
    "website": ["website", "site", "web_site", "url", "domain"],
    "booking_url": ["booking_url", "reservation_url", "book_online", "reserve_url"],
    "rating": ["rating", "review_rating", "stars", "average_rating", "score",
               "totalscore"],
    "review_count": ["review_count", "reviews", "reviews_count", "reviewscount",
                     "user_ratings_total", "number_of_reviews", "review_number"],
    "lat": ["lat", "latitude"],
    "lng": ["lng", "lon", "long", "longitude"],
    "status_raw": ["status", "business_status", "state"],
    "maps_url": ["maps_url", "link", "google_maps_url", "url_maps", "google_url"],
}
CLOSURE_FLAGS = {
    "permanently_closed": "Permanently closed",
    "permanentlyclosed": "Permanently closed",
    "temporarily_closed": "Temporarily closed",
    "temporarilyclosed": "Temporarily closed",
}
NESTED_COORDS = ["location", "gps_coordinates", "coordinates", "geometry"]
PRODUCER_PROFILES = {
    "gosom": ["title", "category", "review_count", "cid"],
    "apify": ["title", "categoryName", "totalScore", "placeId"],
    "outscraper": ["name", "full_address", "reviews", "place_id"],
}
SUPPRESSION_DATE_FIELDS = ["suppressed_at", "contacted_at", "contacted", "date",
                           "added_at", "last_contacted", "timestamp"]

RATING_BANDS = [("excellent", 4.5), ("good", 4.0), ("mixed", 3.0), ("poor", 0.0)]

DEFAULT_COLUMNS = ["score", "name", "category", "address", "phone", "website",
                   "booking_url", "rating", "review_count", "web_presence",
                   "trade_match", "outcome", "qualified", "reject_reason",
                   "failed_signals", "cid", "source"]

# What a source cannot supply, and what stands in for it.
SOURCE_CAPS = {
    "file": {"takes": "path", "cannot_measure": [], "instead": {}},
    "osm": {"takes": "places",
            "cannot_measure": ["reviews", "review_velocity", "establishment_age",
                               "reviews_live"], "instead": {}},
    "mapsearch": {"takes": "places",
                  "cannot_measure": ["reviews", "review_velocity",
                                     "establishment_age"],
                  "instead": {"reviews": "rating_band"}},
}
