"""Fixed values.  They decide results, so they are kept together and in plain text."""

# --- fixed values -----------------------------------------------------------------------
PROVIDER_CODES = [
    "AA-AIRTEL", "JZ-REGINF", "VM-", "AD-", "AX-", "BW-", "TM-",
    "VK-", "VF-", "IM-", "ID-", "BP-", "BZ-", "AW-",
]

CALL_TYPES = ["CALL-IN", "CALL-OUT", "SMS-IN", "SMS-OUT"]
VOICE_TYPES = ["CALL-IN", "CALL-OUT"]
SMS_TYPES = ["SMS-IN", "SMS-OUT"]

PATTERN_DAYS = ["Tuesday", "Friday"]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# canonical name -> column name in the source files
CDR_COLUMNS = {
    "a_party": "A PARTY", "b_party": "B PARTY", "date": "DATE", "time": "TIME",
    "duration": "DURATION", "call_type": "CALL TYPE", "first_cell": "FIRST CELL ID A",
    "last_cell": "LAST CELL ID A", "imei": "IMEI A", "imsi": "IMSI A",
    "address": "FIRST CELL ID A ADDRESS", "lat": "LATITUDE", "lon": "LONGITUDE",
}

IPDR_COLUMNS = [
    "subscriber_id", "imei", "imsi", "start_time", "end_time", "source_ip", "destination_ip",
    "source_port", "destination_port", "protocol", "data_volume_up", "data_volume_down",
    "app_protocol", "session_duration",
]
IPDR_REQUIRED = [
    "subscriber_id", "start_time", "end_time", "destination_ip", "destination_port",
    "data_volume_up", "data_volume_down",
]

# canonical name -> accepted headings, first match wins
TOWER_ALIASES = {
    "timestamp": ["timestamp", "datetime", "date_time", "call_time", "connection_time"],
    "date": ["date", "call_date", "connection_date"],
    "time": ["time", "call_time", "connection_time"],
    "mobile_number": ["mobile_number", "msisdn", "phone_number", "a_party", "subscriber", "a party"],
    "imei": ["imei", "device_id", "equipment_id", "imei a", "imei_a"],
    "imsi": ["imsi", "sim_id", "subscriber_id", "imsi a", "imsi_a"],
    "tower_id": [
        "tower_id", "cell_id", "bts_id", "site_id", "tower", "first cell id a", "last cell id a",
    ],
    "lat": ["lat", "latitude", "tower_lat", "site_lat"],
    "long": ["long", "longitude", "lon", "tower_long", "site_long"],
    "duration": ["duration", "connection_duration", "session_time"],
    "signal_strength": ["signal_strength", "rssi", "signal_level"],
    "b_party": ["b_party", "called_number", "b party"],
    "call_type": ["call_type", "call type", "type"],
}

TOWER_DIM_ALIASES = {
    "tower_id": ["tower_id", "cell_id", "site_id", "bts_id"],
    "lat": ["lat", "latitude", "tower_lat"],
    "long": ["long", "longitude", "lon", "tower_long"],
    "address": ["address", "location", "site_address"],
    "area": ["area", "locality", "region"],
    "city": ["city", "district"],
    "state": ["state", "province"],
    "coverage_radius": ["coverage_radius", "radius", "range"],
}

TOWER_TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy hh:mm:ss a", "dd/MM/yyyy hh:mm:ss a",
]
TOWER_REQUIRED = ["timestamp", "mobile_number", "tower_id"]

# application -> ports, risk, kind; tried from the top, first match wins
APP_SIGNATURES = {
    "whatsapp": ([443, 5222], "HIGH", "encrypted_messaging"),
    "telegram": ([443], "HIGH", "encrypted_messaging"),
    "signal": ([443], "HIGH", "encrypted_messaging"),
    "threema": ([5222], "HIGH", "encrypted_messaging"),
    "banking": ([443, 8443], "MEDIUM", "financial"),
    "video_call": ([3478, 19302], "MEDIUM", "communication"),
    "vpn": ([1194, 1723, 500], "HIGH", "anonymization"),
    "tor": ([9001, 9050], "CRITICAL", "anonymization"),
}
TCP_ONLY_APPS = ["whatsapp", "telegram"]
ENCRYPTED_APPS = ["whatsapp", "telegram", "signal", "threema"]
MESSENGER_APPS = ["whatsapp", "telegram", "signal"]
STANDARD_PORTS = [80, 443, 8080, 8443, 25, 587, 110, 143, 993, 995]

PORT_SERVICES = {
    80: "HTTP", 443: "HTTPS", 8080: "HTTP-Alt", 8443: "HTTPS-Alt", 25: "SMTP",
    587: "SMTP-Submission", 110: "POP3", 143: "IMAP", 993: "IMAPS", 995: "POP3S", 22: "SSH",
    23: "Telnet", 21: "FTP", 3306: "MySQL", 5432: "PostgreSQL", 6379: "Redis",
    27017: "MongoDB", 1194: "OpenVPN", 9001: "Tor", 4444: "Metasploit", 6667: "IRC",
    5060: "SIP/VoIP",
}

P2P_PORTS = [
    6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889, 4662, 4672, 1214, 6346, 6347,
    8333, 30303,
]

# name, latitude, longitude
BORDER_AREAS = [
    ("India-Pakistan Border", 32.5200, 74.5229),
    ("India-Bangladesh Border", 24.3745, 88.6042),
    ("India-China Border", 34.0479, 77.5773),
]

EARTH_RADIUS_KM = 6371.0
# --- end of fixed values ----------------------------------------------------------------
