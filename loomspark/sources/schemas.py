"""Column names of the raw tab-separated files, by position."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# fixed values: file formats
EXPORT = """GlobalEventID Day MonthYear Year FractionDate Actor1Code Actor1Name Actor1CountryCode Actor1KnownGroupCode Actor1EthnicCode
Actor1Religion1Code Actor1Religion2Code Actor1Type1Code Actor1Type2Code Actor1Type3Code Actor2Code Actor2Name Actor2CountryCode
Actor2KnownGroupCode Actor2EthnicCode Actor2Religion1Code Actor2Religion2Code Actor2Type1Code Actor2Type2Code Actor2Type3Code IsRootEvent
EventCode EventBaseCode EventRootCode QuadClass GoldsteinScale NumMentions NumSources NumArticles AvgTone Actor1Geo_Type Actor1Geo_Fullname
Actor1Geo_CountryCode Actor1Geo_ADM1Code Actor1Geo_ADM2Code Actor1Geo_Lat Actor1Geo_Lon Actor1Geo_FeatureID Actor2Geo_Type Actor2Geo_Fullname
Actor2Geo_CountryCode Actor2Geo_ADM1Code Actor2Geo_ADM2Code Actor2Geo_Lat Actor2Geo_Lon Actor2Geo_FeatureID ActionGeo_Type ActionGeo_Fullname
ActionGeo_CountryCode ActionGeo_ADM1Code ActionGeo_ADM2Code ActionGeo_Lat ActionGeo_Lon ActionGeo_FeatureID DATEADDED SOURCEURL""".split()
GKG = """GKGRECORDID V2.1DATE V2.1SourceCollectionIdentifier V2.1SourceCommonName V2.1DocumentIdentifier V2.1Counts V2.1V2Counts V2.1Themes
V2.1EnhancedThemes V2.1Locations V2.1EnhancedLocations V2.1Persons V2.1EnhancedPersons V2.1Organizations V2.1EnhancedOrganizations V2.1Tone
V2.1EnhancedDates V2.1GCAM V2.1SharingImage V2.1RelatedImages V2.1SocialImageEmbeds V2.1SocialVideoEmbeds V2.1Quotations V2.1AllNames
V2.1Amounts V2.1TranslationInfo V2.1Extras""".split()
MENTIONS = """GlobalEventID EventTimeDate MentionTimeDate MentionType MentionSourceName MentionIdentifier SentenceID Actor1CharOffset
Actor2CharOffset ActionCharOffset InRawText Confidence MentionDocLen MentionDocTone MentionDocTranslationInfo Extras""".split()


def strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])
