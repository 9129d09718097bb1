"""Static dictionaries, from the public DICOM standard (PS3.5, PS3.6, PS3.15, PS3.16)."""

from __future__ import annotations

from typing import NamedTuple

# Value representations, with the length of one value (0: variable).
VR_SIZE = {
    "AE": 0, "AS": 4, "AT": 4, "CS": 0, "DA": 8, "DS": 0, "DT": 0, "FD": 8, "FL": 4, "IS": 0, "LO": 0, "LT": 0, "OB": 1, "OD": 8, "OF": 4, "OL": 4, "OV": 8,
    "OW": 2, "PN": 0, "SH": 0, "SL": 4, "SQ": 0, "SS": 2, "ST": 0, "SV": 8, "TM": 0, "UC": 0, "UI": 0, "UL": 4, "UN": 0, "UR": 0, "US": 2, "UT": 0, "UV": 8,
}
LONG_VRS = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
TEXT_VRS = frozenset("AE AS CS DA DS DT IS LO LT PN SH ST TM UC UI UR UT".split())
CHARSET_VRS = frozenset("LO LT PN SH ST UC UT".split())
BYTE_VRS = frozenset("OB OD OF OL OV OW UN".split())
NUMBER_FORMATS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "SV": "q", "UV": "Q"}

# Data elements (tag, VR, keyword) that the operators here use.
_TAGS = """
00020000 UL FileMetaInformationGroupLength|00020001 OB FileMetaInformationVersion|00020002 UI MediaStorageSOPClassUID|00020003 UI MediaStorageSOPInstanceUID
00020010 UI TransferSyntaxUID|00020012 UI ImplementationClassUID|00020013 SH ImplementationVersionName|00020016 AE SourceApplicationEntityTitle
00080005 CS SpecificCharacterSet|00080008 CS ImageType|00080012 DA InstanceCreationDate|00080013 TM InstanceCreationTime|00080014 UI InstanceCreatorUID
00080016 UI SOPClassUID|00080018 UI SOPInstanceUID|00080020 DA StudyDate|00080021 DA SeriesDate|00080022 DA AcquisitionDate|00080023 DA ContentDate
0008002A DT AcquisitionDateTime|00080030 TM StudyTime|00080031 TM SeriesTime|00080032 TM AcquisitionTime|00080033 TM ContentTime|00080050 SH AccessionNumber
00080060 CS Modality|00080061 CS ModalitiesInStudy|00080064 CS ConversionType|00080070 LO Manufacturer|00080080 LO InstitutionName|00080081 ST InstitutionAddress
00080090 PN ReferringPhysicianName|00080092 ST ReferringPhysicianAddress|00080094 SH ReferringPhysicianTelephoneNumbers|00080100 SH CodeValue|00080102 SH CodingSchemeDesignator
00080104 LO CodeMeaning|00080201 SH TimezoneOffsetFromUTC|00081010 SH StationName|00081030 LO StudyDescription|0008103E LO SeriesDescription|00081040 LO InstitutionalDepartmentName
00081048 PN PhysiciansOfRecord|00081050 PN PerformingPhysicianName|00081060 PN NameOfPhysiciansReadingStudy|00081070 PN OperatorsName|00081090 LO ManufacturerModelName
00081110 SQ ReferencedStudySequence|00081111 SQ ReferencedPerformedProcedureStepSequence|00081115 SQ ReferencedSeriesSequence|00081140 SQ ReferencedImageSequence
00081150 UI ReferencedSOPClassUID|00081155 UI ReferencedSOPInstanceUID|00081190 UR RetrieveURL|00081199 SQ ReferencedSOPSequence|00082112 SQ SourceImageSequence
00100010 PN PatientName|00100020 LO PatientID|00100021 LO IssuerOfPatientID|00100030 DA PatientBirthDate|00100032 TM PatientBirthTime|00100040 CS PatientSex
00101000 LO OtherPatientIDs|00101001 PN OtherPatientNames|00101010 AS PatientAge|00101020 DS PatientSize|00101030 DS PatientWeight|00101040 LO PatientAddress
00102154 SH PatientTelephoneNumbers|00102155 LT PatientTelecomInformation|00102160 SH EthnicGroup|00104000 LT PatientComments|00180015 CS BodyPartExamined
00180050 DS SliceThickness|00180060 DS KVP|00180088 DS SpacingBetweenSlices|00181000 LO DeviceSerialNumber|00181020 LO SoftwareVersions|00181030 LO ProtocolName
00181063 DS FrameTime|00185100 CS PatientPosition|0020000D UI StudyInstanceUID|0020000E UI SeriesInstanceUID|00200010 SH StudyID|00200011 IS SeriesNumber
00200012 IS AcquisitionNumber|00200013 IS InstanceNumber|00200020 CS PatientOrientation|00200032 DS ImagePositionPatient|00200037 DS ImageOrientationPatient
00200052 UI FrameOfReferenceUID|00200060 CS Laterality|00201041 DS SliceLocation|00201206 IS NumberOfStudyRelatedSeries|00201208 IS NumberOfStudyRelatedInstances
00201209 IS NumberOfSeriesRelatedInstances|00204000 LT ImageComments|00280002 US SamplesPerPixel|00280004 CS PhotometricInterpretation|00280006 US PlanarConfiguration
00280008 IS NumberOfFrames|00280009 AT FrameIncrementPointer|00280010 US Rows|00280011 US Columns|00280030 DS PixelSpacing|00280034 IS PixelAspectRatio
00280100 US BitsAllocated|00280101 US BitsStored|00280102 US HighBit|00280103 US PixelRepresentation|00280106 US SmallestImagePixelValue|00280107 US LargestImagePixelValue
00280301 CS BurnedInAnnotation|00281050 DS WindowCenter|00281051 DS WindowWidth|00281052 DS RescaleIntercept|00281053 DS RescaleSlope|00281054 LO RescaleType
00281101 US RedPaletteColorLookupTableDescriptor|00281102 US GreenPaletteColorLookupTableDescriptor|00281103 US BluePaletteColorLookupTableDescriptor
00281201 OW RedPaletteColorLookupTableData|00281202 OW GreenPaletteColorLookupTableData|00281203 OW BluePaletteColorLookupTableData|00281221 OW SegmentedRedPaletteColorLookupTableData|00281222 OW SegmentedGreenPaletteColorLookupTableData
00281223 OW SegmentedBluePaletteColorLookupTableData|00282110 CS LossyImageCompression
0032000A CS StudyStatusID|00321032 PN RequestingPhysician|00321060 LO RequestedProcedureDescription|00380010 LO AdmissionID|003A0004 CS WaveformOriginality
003A0005 US NumberOfWaveformChannels|003A0010 UL NumberOfWaveformSamples|003A001A DS SamplingFrequency|00400001 AE ScheduledStationAETitle
00400002 DA ScheduledProcedureStepStartDate|00400003 TM ScheduledProcedureStepStartTime|00400006 PN ScheduledPerformingPhysicianName
00400007 LO ScheduledProcedureStepDescription|00400009 SH ScheduledProcedureStepID|00400010 SH ScheduledStationName|00400011 SH ScheduledProcedureStepLocation
00400100 SQ ScheduledProcedureStepSequence|00400275 SQ RequestAttributesSequence|00401001 SH RequestedProcedureID|0040A040 CS ValueType|0040A043 SQ ConceptNameCodeSequence
0040A123 PN PersonName|0040A124 UI UID|0040A160 UT TextValue|0040A375 SQ CurrentRequestedProcedureEvidenceSequence|0040A491 CS CompletionFlag|0040A493 CS VerificationFlag
0040A730 SQ ContentSequence|00420010 ST DocumentTitle|00420011 OB EncapsulatedDocument|00420012 LO MIMETypeOfEncapsulatedDocument|00420015 UL EncapsulatedDocumentLength
00540081 US NumberOfSlices|54000100 SQ WaveformSequence|54001010 OW WaveformData|00620002 SQ SegmentSequence|00620004 US SegmentNumber|00620005 LO SegmentLabel
00620008 CS SegmentAlgorithmType|00620009 LO SegmentAlgorithmName|00700080 CS ContentLabel|00700081 LO ContentDescription|00700084 PN ContentCreatorName|7FE00010 OW PixelData
FFFEE000 NONE Item|FFFEE00D NONE ItemDelimitationItem|FFFEE0DD NONE SequenceDelimitationItem
"""


class TagEntry(NamedTuple):
    tag: str
    vr: str
    keyword: str


TAGS = {t: TagEntry(t, vr, k) for t, vr, k in (x.split() for line in _TAGS.split("\n") for x in line.split("|") if x.strip())}
KEYWORDS = {e.keyword: e.tag for e in TAGS.values()}


def tag_of(name: str) -> str:
    """The 8-digit tag of a keyword, an 8-digit tag or one written (gggg,eeee)."""
    if name in KEYWORDS:
        return KEYWORDS[name]
    bare = name.replace("(", "").replace(")", "").replace(",", "").upper()
    if len(bare) == 8 and all(c in "0123456789ABCDEF" for c in bare):
        return bare
    raise ValueError(f"unknown data element {name!r}")


def vr_of(tag: str) -> str:
    if tag in TAGS:
        return TAGS[tag].vr
    return "UL" if tag.endswith("0000") else "LO" if int(tag[:4], 16) % 2 and tag[4:6] == "00" and tag[6:] != "00" else "UN"


class TransferSyntax(NamedTuple):
    uid: str
    name: str
    little: bool = True
    explicit: bool = True
    compressed: bool = False
    lossy: bool = False


_P = "1.2.840.10008.1.2"
# Transfer syntaxes (suffix of the DICOM root, name, flags: b big-endian, i implicit, c compressed, l lossy).
_SYNTAXES = """
||Implicit VR Little Endian|i
|.1|Explicit VR Little Endian|
|.2|Explicit VR Big Endian|b
|.1.98|Encapsulated Uncompressed Explicit VR Little Endian|c
|.1.99|Deflated Explicit VR Little Endian|c
|.4.50|JPEG Baseline (Process 1)|cl
|.4.51|JPEG Extended (Process 2 and 4)|cl
|.4.57|JPEG Lossless, Non-Hierarchical (Process 14)|c
|.4.70|JPEG Lossless, Non-Hierarchical, First-Order Prediction|c
|.4.80|JPEG-LS Lossless|c
|.4.81|JPEG-LS Near-Lossless|cl
|.4.90|JPEG 2000 Lossless Only|c
|.4.91|JPEG 2000|cl
|.4.92|JPEG 2000 Part 2 Lossless Only|c
|.4.93|JPEG 2000 Part 2|cl
|.4.94|JPIP Referenced|
|.4.95|JPIP Referenced Deflate|c
|.4.100|MPEG2 Main Profile Main Level|cl
|.4.101|MPEG2 Main Profile High Level|cl
|.4.102|MPEG-4 AVC/H.264 High Profile|cl
|.4.103|MPEG-4 AVC/H.264 BD-compatible|cl
|.4.104|MPEG-4 AVC/H.264 High Profile for 2D Video|cl
|.4.105|MPEG-4 AVC/H.264 High Profile for 3D Video|cl
|.4.106|MPEG-4 AVC/H.264 Stereo High Profile|cl
|.4.107|HEVC/H.265 Main Profile|cl
|.4.108|HEVC/H.265 Main 10 Profile|cl
|.4.110|JPEG XL Lossless|c
|.4.111|JPEG XL JPEG Recompression|cl
|.4.112|JPEG XL|cl
|.4.201|High-Throughput JPEG 2000 Lossless Only|c
|.4.202|High-Throughput JPEG 2000 RPCL Lossless Only|c
|.4.203|High-Throughput JPEG 2000|cl
|.4.204|JPIP HTJ2K Referenced|
|.4.205|JPIP HTJ2K Referenced Deflate|c
|.5|RLE Lossless|c
|.6.1|RFC 2557 MIME Encapsulation|
|.6.2|XML Encoding|
|.7.1|SMPTE ST 2110-20 Uncompressed Progressive Active Video|
|.7.2|SMPTE ST 2110-20 Uncompressed Interlaced Active Video|
|.7.3|SMPTE ST 2110-30 PCM Digital Audio|
|.8.1|Deflated Image Frame Compression|c
"""
TRANSFER_SYNTAXES = {
    t.uid: t
    for t in (
        TransferSyntax(_P + s, name, "b" not in f, "i" not in f, "c" in f, "l" in f)
        for s, name, f in (x.split("|")[1:] for x in _SYNTAXES.strip().split("\n"))
    )
}
IMPLICIT, EXPLICIT, BIG, DEFLATED, RLE = _P, _P + ".1", _P + ".2", _P + ".1.99", _P + ".5"

_S = "1.2.840.10008.5.1.4.1.1."
# Storage SOP classes by the entity that they are (suffixes of the storage root).
ENTITY_CLASSES = {
    "KeyObjectSelection": ("88.59",),
    "Segmentation": ("66.4",),
    "StructuredReport": ("88.11", "88.22", "88.33", "88.34"),
    "EncapsulatedDocument": ("104.1", "104.2", "104.3", "104.4", "104.5"),
    "Waveform": ("9.1.1", "9.1.2", "9.1.3", "9.1.4", "9.2.1", "9.3.1", "9.4.1", "9.4.2", "9.5.1", "9.6.1", "9.6.2", "9.7.1", "9.7.2", "9.7.3", "9.7.4", "9.8.1"),
    "PresentationState": ("11.1", "11.2", "11.3", "11.4", "11.5", "11.11"),
}
ENTITY_CLASSES = {k: tuple(_S + x for x in v) for k, v in ENTITY_CLASSES.items()}
ENTITY_MODALITIES = {"KeyObjectSelection": ("KO",), "Segmentation": ("SEG",), "StructuredReport": ("SR",), "EncapsulatedDocument": ("DOC",), "Waveform": ("ECG", "EEG", "EMG", "EOG", "RESP", "HD"), "PresentationState": ("PR",)}
SECONDARY_CAPTURE = _S + "7"
MIME_CLASSES = {"application/pdf": _S + "104.1", "text/xml": _S + "104.2", "model/stl": _S + "104.3", "model/obj": _S + "104.4", "model/mtl": _S + "104.5"}
MIME_EXTENSIONS = {"application/pdf": "pdf", "text/xml": "xml", "application/xml": "xml", "text/plain": "txt", "application/json": "json", "model/stl": "stl", "model/obj": "obj", "model/mtl": "mtl", "image/jpeg": "jpg", "image/png": "png", "image/tiff": "tif", "application/dicom": "dcm", "application/octet-stream": "bin"}
REQUIRED_META = ("00020001", "00020002", "00020003", "00020010")
CONTROL_TAGS = ("FFFEE000", "FFFEE00D", "FFFEE0DD")

# A default de-identification mask, after the basic profile of PS3.15 table E.1-1.
DEFAULT_MASK = {
    "00080014": "U", "00080018": "U", "00080020": "Z", "00080021": "X/D", "00080022": "X/Z", "00080023": "Z/D", "0008002A": "X/Z/D", "00080030": "Z", "00080031": "X/D", "00080032": "X/Z", "00080033": "Z/D",
    "00080050": "Z", "00080080": "X/Z/D", "00080081": "X", "00080090": "Z", "00080092": "X", "00080094": "X", "00080201": "X", "00081010": "X/Z/D", "00081030": "X", "0008103E": "X", "00081040": "X",
    "00081048": "X", "00081050": "X", "00081060": "X", "00081070": "X/Z/D", "00081110": "X/Z", "00081111": "X/Z/D", "00081140": "X/Z/U*", "00081155": "U", "00082112": "X/Z/U*",
    "00100010": "Z", "00100020": "Z", "00100021": "X", "00100030": "Z", "00100032": "X", "00100040": "Z", "00101000": "X", "00101001": "X", "00101010": "X", "00101020": "X", "00101030": "X", "00101040": "X",
    "00102154": "X", "00102155": "X", "00102160": "X", "00104000": "X", "00181000": "X/Z/D", "00181030": "X/D", "0020000D": "U", "0020000E": "U", "00200010": "Z", "00200052": "U", "00204000": "X",
    "00321032": "X", "00321060": "X/Z", "00380010": "X", "00400001": "X", "00400002": "X", "00400003": "X", "00400006": "X", "00400007": "X", "00400010": "X", "00400011": "X", "00400275": "X", "0040A123": "D", "0040A124": "U", "0040A730": "X", "00420010": "D", "00420011": "D", "00700084": "Z",
}
# Further elements of that table, by action.
_MASK_MORE = {
    "X": """00080096 0008009D 00081041 00081049 00081052 00081062 00081080 00081084 00081120 00181004 00181005 00181007 00181008 00181009 0018100A 00203401 00203404 00203406
    00320012 00321020 00321030 00321033 00321067 00321070 00380004 00380011 00380014 0038001E 00380050 00380060 00380061 00380062 00380064 00380300 00380400 00380500
    00400009 0040000B 00400012 00400242 00400243 00400253 00400254 00400600 004006FA 00401001 00401002 00401004 00401005 0040100A 00401011 00401103 00401104 00402001 00402009 00402010 00403001
    00404025 00404027 00404028 00404030 00404034 00404035 00404036 0040A078 0040A07A 0040A07C 0040A354 00700086 00880200 00880904 00880910 00880912
    04000402 04000403 04000404 04000550 04000551 04000561 30060004 30060085 300A0003 300A0196 300A01A6 40080042 40080111 40080118 4008011A 40080202 FFFAFFFA FFFCFFFC
    0010XXXX 50XXXXXX 60XX3000 60XX4000""",
    "Z": "0008009C 00400513 00400562 00400610 00402016 00402017 0040A088 30060026",
    "D": "00400512 00400551 00401101 0040A027 0040A073 00700001 30060002 300A0002",
    "X/D": "00081072 00181400 0018700A",
    "X/Z": "00400555 300A00B2",
    "Z/D": "00180010",
    "X/Z/D": "00080082",
    "K": "00080016 0008001A 0008001B 0008010C 00080117 00080118 00081150",
}
DEFAULT_MASK |= {t: action for action, tags in _MASK_MORE.items() for t in tags.split() if t not in DEFAULT_MASK}
#: What becomes of elements that the table does not name, by VR: names, ages, dates and times, free text, addresses, and UIDs that are not the standard's own.
DEFAULT_MASK_VRS = {"PN": "Z", "AS": "X", "DA": "X/D", "DT": "X/D", "TM": "X/D", "LT": "X", "ST": "X", "UT": "X", "UR": "X", "AE": "X", "UI": "U"}
