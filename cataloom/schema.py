"""Schemas of the catalogue's entities, as DDL for ``spark.read.schema`` and ``createDataFrame``."""

REFERENCE = "struct<name:string,file_name:string>"

ALBUM = (
    "file_name string not null, name string, rating float, rating_count int, release_date date, cover_image_url string, spotify_id string, duplicate_of string, duplicates array<string>, "
    f"artists array<{REFERENCE}>, primary_genres array<string>, secondary_genres array<string>, descriptors array<string>, languages array<string>, "
    "tracks array<struct<name:string,duration_seconds:int,rating:float,position:string>>, "
    f"credits array<struct<artist:{REFERENCE},roles:array<string>>>"
)
ARTIST = "file_name string not null, name string"
EMBEDDING = "file_name string not null, key string not null, embedding array<float>"
TRACK = f"spotify_id string not null, name string, album_file_name string, artists array<{REFERENCE}>, embedding array<float>, duration_ms int"
EVENT = "id bigint not null, topic string not null, key string, correlation_id string, causation_id string, event string, metadata map<string,string>, created_at timestamp_ntz"
SUBSCRIBER = "id string not null, cursor bigint, status int"
DOCUMENT = "id bigint, collection string not null, key string not null, json variant, created_at timestamp_ntz, updated_at timestamp_ntz, expires_at timestamp_ntz"
KEY_VALUE = "key string not null, value binary, updated_at timestamp_ntz, expires_at timestamp_ntz"
JOB = "id string not null, name string not null, next_execution timestamp_ntz, last_execution timestamp_ntz, interval_seconds int, payload binary, claimed_at timestamp_ntz, priority int, created_at timestamp_ntz"
PROFILE_ITEM = "profile_id string not null, file_name string not null, factor int not null"
LIST_SEGMENT = "file_name string not null, root_file_name string not null, name string, other_segments array<string>, albums array<string>"
FILE_STATE = "file_name string not null, status int not null"
NODE = "id string not null, label string not null, name string"
EDGE = "src string not null, dst string not null, type string not null, weight double not null"
