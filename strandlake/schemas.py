"""Record schemas. All fields may be null; column names are those users of such records know."""

from __future__ import annotations

EFFECT = "array<struct<alternateAllele:string,effects:array<string>,geneName:string,geneId:string,featureType:string,featureId:string,biotype:string,rank:int,total:int,transcriptHgvs:string,proteinHgvs:string,cdnaPosition:int,cdnaLength:int,codingSequencePosition:int,codingSequenceLength:int,proteinPosition:int,proteinLength:int,distance:int,messages:array<string>>>"
ANNOTATION = f"struct<ancestralAllele:string,dbSnp:boolean,hapMap2:boolean,hapMap3:boolean,validated:boolean,thousandGenomes:boolean,somatic:boolean,alleleCount:int,alleleFrequency:float,cigar:string,readDepth:int,referenceReadDepth:int,forwardReadDepth:int,referenceForwardReadDepth:int,reverseReadDepth:int,referenceReverseReadDepth:int,transcriptEffects:{EFFECT},attributes:map<string,string>>"
VARIANT = f"referenceName string, start long, end long, names array<string>, referenceAllele string, alternateAllele string, quality double, splitFromMultiAllelic boolean, filtersApplied boolean, filtersPassed boolean, filtersFailed array<string>, annotation {ANNOTATION}"

SCHEMAS = {
    "alignment": "readName string, sequence string, qualityScores string, originalQualityScores string, referenceName string, start long, end long, originalStart long, cigar string, originalCigar string, mappingQuality int, basesTrimmedFromStart int, basesTrimmedFromEnd int, insertSize long, readInFragment int, mateReferenceName string, mateAlignmentStart long, mismatchingPositions string, attributes string, readGroupId string, readGroupSampleId string, readPaired boolean, properPair boolean, readMapped boolean, mateMapped boolean, failedVendorQualityChecks boolean, duplicateRead boolean, readNegativeStrand boolean, mateNegativeStrand boolean, primaryAlignment boolean, supplementaryAlignment boolean",
    "read": "name string, description string, alphabet string, sequence string, length long, qualityScores string, sampleId string, attributes map<string,string>",
    "sequence": "name string, description string, alphabet string, sequence string, length long, sampleId string, attributes map<string,string>",
    "slice": "name string, description string, alphabet string, sampleId string, attributes map<string,string>, sequence string, start long, end long, length long, totalLength long, index int, slices int, strand string",
    "feature": "featureId string, sampleId string, name string, source string, featureType string, referenceName string, start long, end long, strand string, phase int, frame int, score double, geneId string, transcriptId string, exonId string, proteinId string, aliases array<string>, parentIds array<string>, notes array<string>, target string, gap string, derivesFrom string, dbxrefs array<struct<db:string,accession:string>>, ontologyTerms array<struct<db:string,accession:string>>, circular boolean, attributes map<string,string>",
    "coverage": "referenceName string, start long, end long, count double, optSampleId string",
    "variant": VARIANT,
}


def empty(spark, kind: str):
    """A DataFrame of a record kind without rows."""
    return spark.createDataFrame([], SCHEMAS[kind])
