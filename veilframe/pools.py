"""Pools of fictitious values that synthesis draws from."""

MALE_NAMES = """
Aaron Albert Brandon Bruno Carlos Cedric Damian Dennis Edgar Elliot Felix Frank Gavin
Gordon Hector Hugo Ivan Jasper Joel Karl Kevin Leon Lionel Marcus Mateo Nathan Nolan
Oscar Owen Patrick Paul Quentin Raymond Rupert Samuel Simon Tobias Trevor Victor Warren
""".split()

FEMALE_NAMES = """
Abigail Agnes Beatrice Bianca Camille Clara Daphne Diana Edith Elena Fiona Freya Gloria
Greta Hannah Helen Ingrid Irene Jasmine Julia Karen Kayla Laura Lydia Marion Monica
Nadia Nora Olivia Opal Paula Phoebe Rachel Rosa Sabrina Sylvia Tamara Teresa Vera Wendy
""".split()

FAMILY_NAMES = """
Abbott Aldridge Barnes Beckett Calloway Chandler Dalton Dempsey Eastman Ellison Farrell
Fletcher Garner Goodwin Hadley Hartman Ibarra Ingram Jarvis Jennings Keller Kirkland
Lambert Lockhart Maddox Mercer Navarro Norwood Oakley Osborne Palmer Prescott Quigley
Ramsey Rowland Sawyer Stanton Thatcher Townsend Underhill Valentine Vance Wallace
Whitaker Yates Zimmer
""".split()

CITIES = """
Albany Arlington Bedford Bristol Camden Clayton Dayton Dover Easton Elgin Fairview
Franklin Georgetown Greenville Hamilton Hudson Jackson Kingston Lancaster Lebanon
Madison Milford Newport Norwalk Oakland Oxford Portland Quincy Richmond Riverside Salem
Springfield Trenton Union Vernon Warwick Winchester York
""".split()

STREETS = """
Ash Birch Cedar Chestnut Dogwood Elm Forest Garden Hickory Highland Juniper Lake Laurel
Locust Magnolia Main Maple Meadow Mill Oak Orchard Park Pine Poplar River Spring Spruce
Sunset Sycamore Walnut Willow
""".split()

COMPANY_WORDS = """
Alpine Anchor Beacon Bluebird Cascade Compass Copper Delta Evergreen Falcon Granite
Harbor Horizon Ironwood Keystone Lantern Meridian Northwind Orchard Pinnacle Quarry
Redwood Sable Summit Timber Vantage Westbrook
""".split()

COMPANY_ENDINGS = "Corporation Group Holdings Industries Labs Partners Systems".split()

US_STATES = """
AL AK AZ AR CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE
NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY
""".split()

MONTHS = """
January February March April May June July August September October November December
""".split()

DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
